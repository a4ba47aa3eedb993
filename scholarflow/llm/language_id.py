"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to 3 with counts. A byte
costs -log2 of its share in the longest context that the tree holds; a byte that
the context has not seen costs the escape, and then what the next shorter
context says, down to a uniform order -1. The language whose frozen tree gives a
text the shortest code is the prediction.

The trees of all languages are laid out as one automaton: the last three bytes
name the longest context that any tree holds (a state), and a table has the
code length of every (state, byte, language). Scoring a byte is two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_crc, tidy

# the training sample: about so many labelled documents a language, at most so
# many bytes of them, so many languages (the most frequent), so many contexts
SAMPLE_DOCS = 400
SAMPLE_BYTES = 1_500_000
MAX_LANGUAGES = 200
MAX_STATES = 16_384
# code lengths, one a byte and language, that a task holds at a time
CELLS = 1 << 20
UNDETERMINED = "und"


@dataclass(frozen=True)
class Model:
    """Frozen statistics: symbols of bytes, state of the last bytes, code lengths."""

    languages: tuple[str, ...]
    symbol: np.ndarray  # byte -> symbol; 0 stands before the text's first byte
    state: np.ndarray  # (third last, second last, last symbol) -> state
    cost: np.ndarray  # state * symbols + symbol -> code length in bits, by language

    @property
    def symbols(self) -> int:
        return int(self.symbol.max()) + 1


def _padded(data: np.ndarray, offsets: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with three start symbols before each text, and where the bytes went."""
    texts = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))
    at = np.arange(len(data)) + 3 * texts
    out = np.zeros(len(data) + 3 * (len(offsets) - 1), np.int32)
    out[at] = symbol[data]
    return out, at


def train(texts: dict[str, list[bytes]], max_states: int = MAX_STATES) -> Model:
    """Count contexts of order 0 to 3 and freeze their code lengths."""
    languages = tuple(sorted(texts))
    joined = {k: np.frombuffer(b"".join(texts[k]), np.uint8) for k in languages}
    offsets = {k: np.cumsum([0, *map(len, texts[k])]) for k in languages}
    seen = np.zeros(256, bool)
    for data in joined.values():
        seen[data] = True
    symbol = np.full(256, int(seen.sum()) + 1, np.uint8)  # the last one: any other byte
    symbol[seen] = np.arange(1, seen.sum() + 1)
    n = int(symbol.max()) + 1
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by language and order: keys, counts
    for k in languages:
        s, at = _padded(joined[k], offsets[k], symbol)
        key, by_order = s[at].astype(np.int64), []
        for order in range(4):
            if order:
                key = key + s[at - order].astype(np.int64) * n**order
            by_order.append(np.unique(key, return_counts=True))
        grams.append(by_order)
    # the contexts that become states, the most frequent ones of each order first
    contexts = [np.zeros(1, np.int64)]
    room = max_states - 1
    for order in (1, 2, 3):
        keys = np.concatenate([g[order][0] // n for g in grams] or [np.zeros(0, np.int64)])
        counts = np.concatenate([g[order][1] for g in grams] or [np.zeros(0, np.int64)])
        found, where = np.unique(keys, return_inverse=True)
        total = np.bincount(where, counts, len(found))
        best = np.lexsort((found, -total))[: max(room, 0)]
        contexts.append(np.sort(found[best]))
        room -= len(best)
    first = np.cumsum([0, *[len(c) for c in contexts]])
    cost = np.empty((int(first[-1]), n, len(languages)), np.float32)
    for j, by_order in enumerate(grams):
        lower = np.full((1, n), 8.0)  # order -1: any byte alike
        for order in range(4):
            keys, counts = by_order[order]
            own = contexts[order]
            place = np.searchsorted(own, keys // n)
            known = (place < len(own)) & (own[np.minimum(place, len(own) - 1)] == keys // n) if len(own) else np.zeros(len(keys), bool)
            table = np.zeros((len(own), n))
            table[place[known], keys[known] % n] = counts[known]
            total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
            if order:
                shorter = own % n ** (order - 1)
                held = contexts[order - 1]
                under = np.minimum(np.searchsorted(held, shorter), len(held) - 1)
                lower = np.where((held[under] == shorter)[:, None], lower[under], 8.0) if len(own) else np.zeros((0, n))
            with np.errstate(divide="ignore", invalid="ignore"):
                escaped = np.log2((total + kinds) / np.maximum(kinds, 1)) + lower
                bits = np.where(table > 0, np.log2((total + kinds) / np.maximum(table, 1)), escaped)
            bits = np.where(total > 0, bits, lower)
            cost[first[order] : first[order + 1], :, j] = bits
            lower = bits
    state = np.zeros(n**3, np.int32)
    last = np.arange(n**3)
    for order in (1, 2, 3):
        own = contexts[order]
        if len(own):
            place = np.minimum(np.searchsorted(own, last % n**order), len(own) - 1)
            hit = own[place] == last % n**order
            state[hit] = first[order] + place[hit]
    return Model(languages, symbol, state, cost.reshape(-1, len(languages)))


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every text under every language: an array (texts, languages)."""
    n = model.symbols
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    full = np.flatnonzero(np.diff(offsets))
    if len(full) == 0:
        return out
    s, at = _padded(data, offsets, model.symbol)
    key = (s[at - 3] * n + s[at - 2]) * n + s[at - 1]
    row = model.state[key].astype(np.int64) * n + s[at]
    out[full] = np.add.reduceat(np.take(model.cost, row, axis=0), offsets[full], axis=0, dtype=np.float64)
    return out


def sample(docs: DataFrame, learn, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
           per_language: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """The bounded training sample: whole texts, chosen by a hash of the id."""
    labelled = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {
        r["lang"]: r["n"]
        for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES).collect()
    }
    if not counts:
        return {}
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, per_language / n)])
    rows = (
        labelled.where(F.col("lang").isin(list(counts)))
        .where(draw < share[F.col("lang")])
        .select("lang", F.encode("text", "UTF-8").alias("bytes"))
        .limit(2 * per_language * len(counts) + 100)
        .toLocalIterator()
    )
    out: dict[str, list[bytes]] = {k: [] for k in counts}
    size = dict.fromkeys(counts, 0)
    for r in rows:
        if size[r["lang"]] < max_bytes:
            out[r["lang"]].append(bytes(r["bytes"]))
            size[r["lang"]] += len(r["bytes"])
    return {k: v for k, v in out.items() if size[k]}


def scored(model: Model | None, batch: pa.RecordBatch, kept: bool) -> Iterator[pa.RecordBatch]:
    """Columns row, lang_pred, score and, if it is kept, text, for ``batch`` with row, letters, text.

    Texts that are scored together go back together: a worker holds the code lengths
    of one run of them, and no second batch of texts.
    """
    languages = model.languages if model else ()
    named = np.array([*languages, UNDETERMINED], dtype=object)
    for lo, hi, data, offsets in slices(batch, "text", max(CELLS // max(len(languages), 1), 1)):
        part = batch.slice(lo, hi - lo)
        best, sure = np.full(hi - lo, len(languages)), np.zeros(hi - lo)
        if model is not None:
            valid = part.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            bits = code_lengths(model, data, offsets)
            odds = np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000.0))
            best = np.where(valid, bits.argmin(1), len(languages))
            sure = np.where(valid, 1.0 / odds.sum(1), 0.0)
        yield pa.RecordBatch.from_arrays(
            [part.column("row"), pa.array(named[best], pa.string()), pa.array(sure), *([part.column("text")] if kept else [])],
            names=["row", "lang_pred", "score", *(["text"] if kept else [])],
        )


def predict(docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep``, doc_id, lang_pred and score for every row, whole texts.

    A text that is NULL or has no letter (\\p{L}) gets ``und`` and score 0, as
    does every text when there is no model, that is, nothing to learn from.
    Otherwise the score is the posterior of the predicted language under equal
    priors; equal code lengths go to the first language in alphabetical order.
    Repeated rows are scored one by one.
    """
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # a text that is kept travels once
    columns = [F.col(f"`{c}`") for c in keep if c != text]
    given = docs.select(
        F.struct(*columns, F.col(doc_id).alias("_doc_id")).alias("row"),
        letters.alias("letters"),
        F.col(text).alias("text"),
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = text in keep

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from scored(shared.value, batch, kept)

    schema = given.select("row").schema.add("lang_pred", "string").add("score", "double")
    if kept:
        schema = schema.add("text", "string")
    out = given.mapInArrow(tidy(score), schema)
    return out.select(
        *[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in keep],
        F.col("row._doc_id").alias(doc_id),
        "lang_pred",
        "score",
    )


def fit(docs: DataFrame, learn, **columns) -> Model | None:
    """Trees learned from the rows where ``learn`` holds; None without such rows."""
    texts = sample(docs, learn, **columns)
    return train(texts) if texts else None


def language_id(docs: DataFrame, *, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from ``text`` and non-NULL ``lang`` of the rows whose crc32 of the id,
    modulo ``folds``, is not 0. A NULL id counts as empty text, whose remainder
    is 0. Other columns are not read.
    """
    remainder = F.pmod(text_crc("doc_id"), F.lit(folds))
    model = fit(docs, remainder != 0)
    out = predict(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", (F.pmod(text_crc("doc_id"), F.lit(folds)) == 0).alias("held_out"), "lang_pred", "score"
    )
