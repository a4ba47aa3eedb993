"""Language-model scores by masked pseudo-likelihood.

A window network predicts every token from the two tokens on its left and the
two on its right: their vectors make a hidden layer, and a softmax over classes
names the masked one. A document's score is the sum of the log-probabilities of
its tokens. The most frequent words of the corpus are classes of their own;
other words share classes with words of about their frequency, classes of about
equal counts, and inside a class a word has its own share of the class's count in
the corpus. The number of classes grows with the cube root of the vocabulary.

All statistics cover the whole corpus: texts are cut into blocks with their
distinct words, whose counts are a Spark table that the blocks' words are joined
with, and every document trains the network, in rounds. In a round each task starts
from the common parameters, takes gradient steps over its documents of that
round, and the parameters are averaged, weighted by tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType

from .common import LOWER, byte_values, prefix_hashes, slices, span_hashes, staged, words

# the least number of classes; three quarters of the classes are single words
CLASSES = 64
# a row is a block of texts, so few rows go to a Python worker at a time
BATCH_BYTES = "8m"
# bytes of text of a block: larger ones have fewer distinct words in all
BLOCK_BYTES = 4 << 20
SIDE, SIZE, HIDDEN = 2, 8, 16
BORDER = CLASSES  # the token beyond a text's ends
ROUNDS, BATCH, RATE = 2, 4096, 1.5
RUN = 1024  # tokens that are worked on at a time


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words after lower-casing A-Z, and the first word of each text."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    return span_hashes(prefix_hashes(byte_values(data)), starts, ends), first


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 to 2^28 - 1 in one to four bytes each, seven bits a byte, the last one below 128."""
    size = 1 + (values >= 1 << 7) + (values >= 1 << 14) + (values >= 1 << 21)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(4):
        there = size > k
        more = (size[there] > k + 1).astype(np.uint8) << 7
        out[at[there] + k] = ((values[there] >> 7 * k) & 127).astype(np.uint8) | more
    return out.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The numbers of ``packed``."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1] + 1])
    out = np.zeros(len(ends), np.int64)
    for k in range(4):
        there = np.flatnonzero(ends - starts >= k)
        out[there] |= (data[starts[there] + k] & 127).astype(np.int64) << 7 * k
    return out


def blocks(docs: DataFrame) -> DataFrame:
    """Runs of rows: (doc_id, draw, first, token, word, n), arrays but for ``token``.

    ``word`` has the hashes of the block's distinct words, the frequent ones first, and
    ``n`` their counts in it; ``token`` has the places in ``word`` of its tokens,
    ``packed``, and ``first`` the first token of each row; ``draw`` is a hash of its text.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text", BLOCK_BYTES):
                hashes, first = word_hashes(data, offsets)
                word, token, n = np.unique(hashes, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                ids, draw = (batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "draw"))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                yield pa.RecordBatch.from_arrays(
                    [one(pa.concat_arrays([ids])), one(pa.concat_arrays([draw])), one(pa.array(first.astype(np.int32))),
                     pa.array([packed(rank[token])], pa.binary()),
                     one(pa.array(word[order].view(np.int64))), one(pa.array(n[order].astype(np.int64)))],
                    names=["doc_id", "draw", "first", "token", "word", "n"],
                )

    given = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("draw"))
    schema = given.select("doc_id").schema
    schema[0].dataType = ArrayType(schema[0].dataType)
    schema = schema.add("draw", ArrayType(LongType())).add("first", ArrayType(IntegerType())).add("token", BinaryType())
    return given.mapInArrow(cut, schema.add("word", ArrayType(LongType())).add("n", ArrayType(LongType())))


def block_counts(cut: DataFrame) -> DataFrame:
    """(word, n) over all blocks."""
    pairs = cut.select(F.explode(F.arrays_zip("word", "n")).alias("x")).select("x.word", "x.n")
    return pairs.groupBy("word").agg(F.sum("n").alias("n"))


def counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its hash, occurs in the corpus."""
    return block_counts(blocks(docs))


@dataclass
class Vocabulary:
    """Which class a word is in, by its hash and its count, and the classes' counts.

    Words that are no class of their own lie on a line by falling count, each as
    long as its count, and equal counts by hash; the line is cut into ``shared``
    equal parts.
    """

    frequent: np.ndarray  # sorted hashes
    count: np.ndarray  # distinct counts of the other words, rising
    before: np.ndarray  # tokens of the words with a higher count
    mass: np.ndarray  # tokens of the words with that count
    shared: int
    used: np.ndarray | None = None  # classes that hold words
    total: np.ndarray | None = None  # their tokens

    @property
    def size(self) -> int:
        return max(len(self.used), 1)

    def places(self, word: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The class of each word, before classes without words are left out."""
        out = np.zeros(len(word), np.int64)
        if len(self.count):
            at = np.minimum(np.searchsorted(self.count, n), len(self.count) - 1)
            where = (self.before[at] + self.mass[at] * (word / 2.0**64)) / self.mass.sum()
            out = len(self.frequent) + np.minimum((where * self.shared).astype(np.int64), self.shared - 1)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, word), len(self.frequent) - 1)
            out = np.where(self.frequent[at] == word, at, out)
        return out

    def classes(self, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and its log-share in the class."""
        out = np.searchsorted(self.used, self.places(word, n))
        return out, np.log(n / self.total[out])


def vocabulary(counted: DataFrame) -> Vocabulary:
    """Classes for the words: single ones by count (ties by hash), the others by parts.

    The driver gets one row per class and one per distinct count, of which a
    corpus of T tokens has fewer than sqrt(2 T).
    """
    classes = max(CLASSES, int(np.ceil(counted.count() ** (1 / 3))))
    top = counted.orderBy(F.desc("n"), "word").limit(classes * 3 // 4).collect()
    frequent = np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))
    levels = counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toPandas().sort_values("n")
    count, held = levels["n"].to_numpy(np.int64), levels["words"].to_numpy(np.int64)
    single, times = np.unique(np.array([r["n"] for r in top], np.int64), return_counts=True)
    held[np.searchsorted(count, single)] -= times
    count, held = count[held > 0], held[held > 0]
    mass = (count * held).astype(np.float64)
    known = Vocabulary(frequent, count, mass.sum() - np.cumsum(mass), mass, classes - classes * 3 // 4)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            at, where = np.unique(known.places(batch.column("word").to_numpy().view(np.uint64), n), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.bincount(where, n, len(at)))], names=["place", "n"])

    placed = counted.select("word", "n").mapInArrow(place, "place long, n double").groupBy("place").agg(F.sum("n").alias("n"))
    found = placed.toPandas().sort_values("place")
    known.used, known.total = found["place"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    return known


def encoded(cut: DataFrame, counted: DataFrame, known: Vocabulary) -> DataFrame:
    """(doc_id, draw, token, share) of every row: its tokens' classes, two bytes each, and
    the sum of their log-shares.

    Each block's distinct words meet their counts by a shuffled join on the word, and
    go back to the block as classes; the words themselves travel once.
    """
    shared = cut.sparkSession.sparkContext.broadcast(known)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, _ = shared.value.classes(batch.column("word").to_numpy().view(np.uint64), batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("at"), pa.array(group.astype(np.int16)), batch.column("n")],
                names=["block", "at", "group", "n"],
            )

    pairs = cut.select("block", F.posexplode("word").alias("at", "word")).join(counted, "word")
    found = pairs.select("block", "at", "word", "n").mapInArrow(classed, "block long, at int, group short, n long")
    # lists of one aggregate have one order
    found = found.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in ("at", "group", "n")])
    given = cut.select("block", "doc_id", "draw", "first", "token").join(found, "block", "left").drop("block")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, draw = (batch.column(c).slice(i, 1).flatten() for c in ("doc_id", "draw"))
                first, at, group, n = (batch.column(c).slice(i, 1).flatten().to_numpy() for c in ("first", "at", "group", "n"))
                token = unpacked(batch.column("token")[i].as_py())
                own, share = np.empty(len(at), "<i2"), np.empty(len(at))
                own[at] = group
                share[at] = np.log(n / shared.value.total[group]) if len(at) else 0.0
                each = np.concatenate([[0.0], np.cumsum(share[token])])
                values = pa.py_buffer(own[token].tobytes())
                offsets = pa.py_buffer((2 * first.astype(np.int32)).tobytes())
                texts = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, values])
                yield pa.RecordBatch.from_arrays(
                    [ids, draw, texts, pa.array(np.diff(each[first]))], names=["doc_id", "draw", "token", "share"]
                )

    schema = cut.select("doc_id").schema
    schema[0].dataType = schema[0].dataType.elementType
    return given.mapInArrow(encode, schema.add("draw", "long").add("token", "binary").add("share", "double"))


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of an encoded table: (first row, end row, tokens, first token of each row)."""
    for lo, hi, data, offsets in slices(batch, "token", 1 << 20):
        yield lo, hi, np.frombuffer(data.tobytes(), "<i2").astype(np.int64), offsets // 2


def contexts(token: np.ndarray, first: np.ndarray, border: int = BORDER) -> np.ndarray:
    """The tokens around each token, from left to right: (tokens, 2 * SIDE)."""
    lengths = np.diff(first)
    at = np.arange(len(token)) + SIDE * (2 * np.repeat(np.arange(len(lengths)), lengths) + 1)
    padded = np.full(len(token) + 2 * SIDE * len(lengths), border)
    padded[at] = token
    return np.stack([padded[at + k] for k in range(-SIDE, SIDE + 1) if k], axis=1)


class Network:
    """One hidden layer between the vectors of a context and the class in its middle."""

    @staticmethod
    def shapes(classes: int) -> dict[str, tuple[int, ...]]:
        return {
            "E": (classes + 1, SIZE), "W": (2 * SIDE * SIZE, HIDDEN), "b": (HIDDEN,), "O": (HIDDEN, classes), "c": (classes,),
        }

    def __init__(self, flat: np.ndarray, classes: int = CLASSES):
        self.p, self.classes, at = {}, classes, 0
        for name, shape in self.shapes(classes).items():
            n = int(np.prod(shape))
            self.p[name] = flat[at : at + n].reshape(shape).astype(np.float32)
            at += n

    @classmethod
    def initial(cls, classes: int = CLASSES, seed: int = 11) -> np.ndarray:
        rng = np.random.default_rng(seed)
        scale = {"E": 0.3, "W": (2 * SIDE * SIZE) ** -0.5, "b": 0.0, "O": HIDDEN**-0.5, "c": 0.0}
        return np.concatenate([scale[k] * rng.standard_normal(int(np.prod(s))) for k, s in cls.shapes(classes).items()])

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in self.p]).astype(np.float64)

    def _run(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.p["E"][context].reshape(len(context), -1)
        h = np.tanh(x @ self.p["W"] + self.p["b"])
        logit = h @ self.p["O"] + self.p["c"]
        logit -= logit.max(1, keepdims=True)
        return x, h, logit

    def log_probabilities(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        out = np.empty(len(token))
        for i in range(0, len(token), RUN):
            _, _, logit = self._run(context[i : i + RUN])
            rows = np.arange(len(logit))
            out[i : i + RUN] = logit[rows, token[i : i + RUN]] - np.log(np.exp(logit).sum(1))
        return out

    def gradients(self, context: np.ndarray, token: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-probability and its gradients."""
        n, (x, h, logit) = len(token), self._run(context)
        rows = np.arange(n)
        prob = np.exp(logit)
        total = prob.sum(1, keepdims=True)
        loss = float((np.log(total[:, 0]) - logit[rows, token]).mean())
        prob /= total
        prob[rows, token] -= 1
        prob /= n
        dh = (prob @ self.p["O"].T) * (1 - h * h)
        dx = (dh @ self.p["W"].T).reshape(-1, SIZE)
        where = context.ravel()
        dE = np.stack([np.bincount(where, dx[:, k], self.classes + 1) for k in range(SIZE)], axis=1)
        return loss, {"E": dE, "W": x.T @ dh, "b": dh.sum(0), "O": h.T @ prob, "c": prob.sum(0)}

    def learn(self, context: np.ndarray, token: np.ndarray, memory: dict[str, np.ndarray]) -> None:
        """One step of gradient descent, scaled by the running size of the gradients.

        The step's gradients are put together from runs that fit a processor's cache.
        """
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        for i in range(0, len(token), RUN):
            run = token[i : i + RUN]
            for k, v in self.gradients(context[i : i + RUN], run)[1].items():
                g[k] += (v * (len(run) / len(token))).astype(np.float32)
        for k, v in self.p.items():
            memory[k] = memory.get(k, 0.0) + g[k] ** 2
            v -= (0.1 * RATE * g[k] / (np.sqrt(memory[k]) + 1e-8)).astype(np.float32)


def _round(docs: DataFrame, classes: int, start: np.ndarray) -> np.ndarray:
    """The average of the tasks' parameters after one pass over ``docs``.

    Each task gives one row per parameter block; sums are aggregated by Spark, so
    what reaches the driver is one vector, however many tasks there are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(start)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, memory, seen = Network(shared.value, classes), {}, 0
        for batch in batches:
            for _, _, token, first in _tokens(batch):
                around = contexts(token, first, classes)
                order = np.random.default_rng(len(token)).permutation(len(token))
                for i in range(0, len(order), BATCH):
                    pick = order[i : i + BATCH]
                    net.learn(around[pick], token[pick], memory)
                seen += len(token)
        if seen:
            values = net.flat() * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values) + 1)), pa.array(np.append(values, seen))], names=["at", "value"]
            )

    sums = docs.select("token").mapInArrow(local, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    rows = sums.toPandas().sort_values("at")["value"].to_numpy()
    return rows[:-1] / rows[-1] if len(rows) else start


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary, np.ndarray]:
    """The encoded rows of ``docs``, the vocabulary and the parameters from all of them.

    A document takes part in the round that a hash of its text names.
    """
    cut = staged(blocks(docs).withColumn("block", F.monotonically_increasing_id()))
    counted = staged(block_counts(cut))
    known = vocabulary(counted)
    rows = staged(encoded(cut, counted, known), BATCH_BYTES)
    params = Network.initial(known.size)
    for k in range(rounds):
        turn = rows.where(F.pmod("draw", F.lit(rounds)) == k)
        params = _round(turn, known.size, params)
    return rows, known, params


def lm_scores(docs: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, per_token of every document.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z;
    ``log_likelihood`` sums their natural log-probabilities, each given all other
    tokens in reach, and ``per_token`` is its mean. A NULL, empty or blank text has no
    tokens and 0 in both. Repeated rows are scored one by one, and count as often
    as they come. Other columns are not read.
    """
    rows, known, params = fit(docs, rounds)
    classes = known.size
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value, classes)
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), batch.column("share").to_numpy().copy()
            for lo, hi, token, first in _tokens(batch):
                each = np.concatenate([[0.0], np.cumsum(net.log_probabilities(contexts(token, first, classes), token))])
                n[lo:hi] = np.diff(first)
                total[lo:hi] += np.diff(each[first])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))],
                names=["doc_id", "n_tokens", "log_likelihood", "per_token"],
            )

    schema = rows.select("doc_id").schema.add("n_tokens", "long").add("log_likelihood", "double").add("per_token", "double")
    return rows.mapInArrow(score, schema)
