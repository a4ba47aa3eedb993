"""How far the sources of a language diverge, from bitmaps of equal counts.

For every (group, count) there is a bitmap of the terms that the group holds so many
times; a group is a source of a language. A term's ids are dealt in chunks, so a
bitmap is cut the same way for all groups. AND and popcount of two groups' bitmaps
give the number of terms with each pair of counts, and all terms of such a cell have
the same divergence f, which is computed once and multiplied. Cells in which a group
has a count of zero need no bitmap: they are what is left of the other group's counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, ragged, slices, staged

SCALE = 1_000_000_000
# terms of a chunk: many where counts are few, since its bitmaps are compared level by level
MOST_TERMS, LEAST_TERMS, FEW = 1 << 16, 64, 3
# 64-bit words of a chunk's bitmaps, and terms' counts that wait for theirs, in a task
WORDS, WAITING = 1 << 22, 1 << 22
# groups of a block; two blocks meet in a task
BLOCK = 64
TEXT_BYTES = 8 << 20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of ASCII letters and other non-ASCII bytes in the texts."""
    inside = _INSIDE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True  # no term spans two texts
    begin = inside & np.concatenate([[True], ~inside[:-1] | cut[1:-1]]) if len(data) else inside
    last = inside & (np.concatenate([~inside[1:], [True]]) | cut[1:]) if len(data) else inside
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _words_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The lower-cased terms, dictionary-encoded by their bytes."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    body = LOWER[data[ragged(starts, lengths)]]
    array = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))
    return array.dictionary_encode()


_COUNTED = "lang string, term string, sources array<long>, counts array<long>, held array<long>"


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int64()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per run of rows, language and term: occurrences and documents in each source."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        lang_code, source = langs.indices.to_numpy(), batch.column("source_key").to_numpy()
        for lo, hi, data, offsets in slices(batch, "text", TEXT_BYTES):
            starts, ends, row = term_spans(data, offsets)
            if not len(starts):
                continue
            terms = _words_of(data, starts, ends)
            code, rows = terms.indices.to_numpy().astype(np.int64), hi - lo
            pairs, often = np.unique(code * rows + row, return_counts=True)  # (term, document)
            code, row = pairs // rows, pairs % rows + lo
            order = np.lexsort((source[row], code, lang_code[row]))
            key = np.stack([lang_code[row], code, source[row]])[:, order]
            changed = np.ones(key.shape[1], bool)
            changed[1:] = (key[:, 1:] != key[:, :-1]).any(0)
            first = np.flatnonzero(changed)
            key = key[:, first]
            counts = np.add.reduceat(often[order], first)
            held = np.diff(np.append(first, len(order)))
            changed = np.ones(len(first), bool)
            changed[1:] = (key[:2, 1:] != key[:2, :-1]).any(0)
            at = np.append(np.flatnonzero(changed), len(first))
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(key[0][at[:-1]])), terms.dictionary.take(pa.array(key[1][at[:-1]])),
                    _lists(key[2], at), _lists(counts, at), _lists(held, at),
                ],
                names=["lang", "term", "sources", "counts", "held"],
            )


def vocabulary(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, total, sources, counts: the terms in ``min_docs`` documents of a language at
    least, with the keys of the sources that hold them and how often they do."""
    counted = docs.select("lang", "source_key", "text").mapInArrow(_count, _COUNTED)
    dealt = counted.repartition("lang", "term")
    flat = dealt.select("lang", "term", F.inline(F.arrays_zip("sources", "counts", "held")))
    # these two are clustered by (lang, term) already
    each = flat.groupBy("lang", "term", F.col("sources").alias("source_key")).agg(F.sum("counts").alias("n"), F.sum("held").alias("held"))
    return (
        each.groupBy("lang", "term")
        .agg(F.sum("held").alias("_held"), F.sum("n").alias("total"), F.collect_list(F.struct("source_key", "n")).alias("_in"))
        .where(F.col("_held") >= min_docs)
        .select("lang", "term", "total", F.col("_in.source_key").alias("sources"), F.col("_in.n").alias("counts"))
    )


_BITMAP = "lang string, chunk string, source_key long, n long, bits binary"


def _chunk_terms(level: int) -> int:
    """Terms of a chunk whose total counts have so many bits."""
    return max(LEAST_TERMS, MOST_TERMS >> 2 * max(0, level - FEW))


class _Chunk:
    """Terms of one language and size of count, until there are enough of them."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.name: str | None = None
        self.terms = self.entries = 0

    def add(self, name: str, ids: np.ndarray, sources: np.ndarray, counts: np.ndarray, terms: int) -> None:
        self.name = self.name or name
        self.parts.append((ids + self.terms, sources, counts))
        self.terms += terms
        self.entries += len(ids)


def _bitmaps(lang: str, name: str, ids: np.ndarray, sources: np.ndarray, counts: np.ndarray, terms: int) -> Iterator[pa.RecordBatch]:
    """One bitmap per (source, count) of a chunk; a chunk whose bitmaps are too large is halved."""
    order = np.lexsort((counts, sources))
    ids, sources, counts = ids[order], sources[order], counts[order]
    new = np.ones(len(ids), bool)
    new[1:] = (sources[1:] != sources[:-1]) | (counts[1:] != counts[:-1])
    width, rows = -(-terms // 64), int(new.sum())
    if rows * width > WORDS and terms > 64:
        half = terms // 128 * 64 or 64
        low = ids < half
        yield from _bitmaps(lang, name + " <", ids[low], sources[low], counts[low], half)
        yield from _bitmaps(lang, name + " >", ids[~low] - half, sources[~low], counts[~low], terms - half)
        return
    row = np.cumsum(new) - 1
    words = np.zeros(rows * width, np.uint64)
    np.bitwise_or.at(words, row * width + (ids >> 6), np.uint64(1) << (ids & 63).astype(np.uint64))
    raw = words.astype("<u8").tobytes()
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([lang] * rows, pa.string()), pa.array([name] * rows, pa.string()), pa.array(sources[new]), pa.array(counts[new]),
            pa.array([raw[8 * width * i : 8 * width * (i + 1)] for i in range(rows)], pa.binary()),
        ],
        names=["lang", "chunk", "source_key", "n", "bits"],
    )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal terms into chunks and give their bitmaps. A chunk is named by its first term, which no other has."""
    chunks: dict[tuple[str, int], _Chunk] = {}

    def close(key: tuple[str, int]) -> Iterator[pa.RecordBatch]:
        chunk = chunks.pop(key)
        ids, sources, counts = (np.concatenate(x) for x in zip(*chunk.parts))
        return _bitmaps(key[0], chunk.name, ids, sources, counts, chunk.terms)

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        level = np.frexp(batch.column("total").to_numpy().astype(np.float64))[1]
        code = langs.indices.to_numpy().astype(np.int64) * 100 + level
        lists = batch.column("sources")
        offsets = lists.offsets.to_numpy()
        all_sources, all_counts = lists.values.to_numpy(), batch.column("counts").values.to_numpy()
        for c in np.unique(code):
            rows = np.flatnonzero(code == c)
            key = (langs.dictionary[int(c) // 100].as_py(), int(c) % 100)
            while len(rows):
                chunk = chunks.setdefault(key, _Chunk())
                take, rows = np.split(rows, [_chunk_terms(key[1]) - chunk.terms])
                lengths = offsets[take + 1] - offsets[take]
                where = ragged(offsets[take].astype(np.int64), lengths.astype(np.int64))
                ids = np.repeat(np.arange(len(take)), lengths)
                chunk.add(batch.column("term")[int(take[0])].as_py(), ids, all_sources[where], all_counts[where], len(take))
                if chunk.terms >= _chunk_terms(key[1]):
                    yield from close(key)
        while sum(c.entries for c in chunks.values()) > WAITING:
            yield from close(max(chunks, key=lambda k: chunks[k].entries))
    for key in list(chunks):
        yield from close(key)


def share(n: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / (total + terms)), in three steps that stay within 64 bits."""
    whole = total + terms
    q, r = np.divmod(n + 1, whole)
    for _ in range(3):
        r *= 1000
        q = q * 1000 + r // whole
        r %= whole
    return q + 1


def _share(n: Column, total: Column, terms: Column) -> Column:
    """``share`` as a column; NULL where there are no terms and no counts."""
    whole = F.nullif(total + terms, F.lit(0))
    large = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(n < SCALE, _div((n + 1) * SCALE, whole)).otherwise(_div(large, whole.cast("decimal(20,0)"))) + 1


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of columns that are not negative."""
    return F.call_function("div", a, b)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


_SUMS = "lang string, source_key long, other_key long, value long"


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the first and of the second block; both the same where a block meets itself."""
    own = group.column("own").to_numpy()
    return np.flatnonzero(own == group.column("i")[0].as_py()), np.flatnonzero(own == group.column("j")[0].as_py())


def _sums(lang: str, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    a, b, value = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int64)]) for i in range(3))
    return pa.table({
        "lang": pa.array([lang] * len(a), pa.string()), "source_key": pa.array(a, pa.int64()), "other_key": pa.array(b, pa.int64()),
        "value": pa.array(value, pa.int64()),
    })


def _runs(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))


def _joint(group: pa.Table) -> pa.Table:
    """Of one chunk and two blocks of groups: what the terms that both of two groups hold add to
    their divergence over what zero counts there would."""
    group = group.sort_by([("own", "ascending"), ("source_key", "ascending"), ("n", "ascending")])
    source, p, p0 = (group.column(c).to_numpy() for c in ("source_key", "p", "p0"))
    bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), "<u8").reshape(len(source), -1)
    left, right = _sides(group)
    same = group.column("i")[0] == group.column("j")[0]
    starts = _runs(source[right])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(left) or not len(right):
        return _sums(group.column("lang")[0].as_py(), found)
    for lo, hi in zip(first := _runs(source[left]), np.append(first[1:], len(left))):
        mine = left[lo:hi]
        a = source[mine[0]]
        cells = np.stack([np.bitwise_count(bits[x] & bits[right]).sum(1, dtype=np.int64) for x in mine])
        q, q0, own, own0 = p[right][None], p0[right][None], p[mine][:, None], p0[mine][:, None]
        there = divergence(own, q) - divergence(own, q0) - divergence(own0, q) + divergence(own0, q0)
        met = np.add.reduceat((cells != 0).any(0), starts) > 0
        keep = met & (source[right][starts] != a)
        others = source[right][starts][keep]
        found.append((np.full(len(others), a), others, np.add.reduceat((cells * there).sum(0), starts)[keep]))
        if not same:
            back = divergence(q, own) - divergence(q, own0) - divergence(q0, own) + divergence(q0, own0)
            found.append((others, np.full(len(others), a), np.add.reduceat((cells * back).sum(0), starts)[keep]))
    return _sums(group.column("lang")[0].as_py(), found)


def _alone(group: pa.Table) -> pa.Table:
    """Of two blocks of groups: each pair's divergence if no term were held by both, from how many
    terms each group holds how often; all other terms are zero on both sides."""
    group = group.sort_by([("own", "ascending"), ("source_key", "ascending")])
    source, p, p0, n_terms = (group.column(c).to_numpy() for c in ("source_key", "p", "p0", "n_terms"))
    terms = group.column("terms")[0].as_py()
    left, right = _sides(group)
    same = group.column("i")[0] == group.column("j")[0]

    def one_way(mine: np.ndarray, theirs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        starts = _runs(source[theirs])
        others, q0 = source[theirs][starts], p0[theirs][starts]
        out = []
        for lo, hi in zip(first := _runs(source[mine]), np.append(first[1:], len(mine))):
            rows = mine[lo:hi]
            own0 = p0[rows[0]]
            zero = divergence(own0, q0)
            value = zero * terms
            value += (n_terms[rows][:, None] * (divergence(p[rows][:, None], q0[None]) - zero[None])).sum(0)
            gain = divergence(own0, p[theirs]) - divergence(own0, p0[theirs])
            value += np.add.reduceat(n_terms[theirs] * gain, starts)
            keep = others != source[rows[0]]
            out.append((np.full(int(keep.sum()), source[rows[0]]), others[keep], value[keep]))
        return out

    found = []
    if len(left) and len(right):
        found = one_way(left, right) + ([] if same else one_way(right, left))
    return _sums(group.column("lang")[0].as_py(), found)


def _meeting(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of groups, once for every block that their own one meets."""
    sized = groups.select("lang", "source_key", "own", "blocks", "occurrences", "terms")
    met = rows.join(sized, ["lang", "source_key"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).withColumn(
        "p0", F.coalesce(_share(F.lit(0).cast("long"), F.col("occurrences"), F.col("terms")), F.lit(1).cast("long"))
    ).withColumn("p", F.coalesce(_share(F.col("n"), F.col("occurrences"), F.col("terms")), F.lit(1).cast("long")))


def divergences(docs: DataFrame, *, min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how the sources of each language diverge.

    NULL text, lang and source count as ''; other columns of ``docs`` are not read,
    and every row is a document, also where rows repeat. Terms are runs of letters
    A-Z, a-z and characters beyond ASCII, with A-Z lower-cased; a language keeps those
    in ``min_docs`` of its documents at least. With V kept terms, a group of N
    occurrences gives a term of count n the share p = 1 + floor(10^9 (n + 1) / (N + V)),
    and p diverges from q by f = floor((p - q)^2 / q). Part 'pair' has for each source
    the sum of f over all kept terms against each other source of its language (0
    without any term); part 'term' the ``top`` terms that the source holds with a
    larger share than its language. Ranks go by value, descending, then by item.
    Sums are exact as long as the result is a long. Sources are told apart by 64-bit hashes.
    """
    given = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]).withColumn(
        "source_key", F.xxhash64("source")
    )
    kept = staged(vocabulary(given, min_docs))
    flat = kept.select("lang", "term", "total", F.inline(F.arrays_zip("sources", "counts"))).withColumnsRenamed(
        {"sources": "source_key", "counts": "n"}
    )
    names = given.select("lang", "source", "source_key").distinct()
    sizes = flat.groupBy("lang", "source_key").agg(F.sum("n").alias("occurrences"))
    langs = names.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("lang_occurrences"))
    none = F.lit(0).cast("long")
    groups = staged(
        names.join(sizes, ["lang", "source_key"], "left").join(langs, "lang").join(totals, "lang", "left")
        .select(
            "lang", "source", "source_key", "blocks", F.pmod(F.xxhash64(F.lit(1), "source_key"), "blocks").cast("int").alias("own"),
            *[F.coalesce(c, none).alias(c) for c in ("occurrences", "terms", "lang_occurrences")],
        )
    )
    bitmaps = kept.mapInArrow(_index, _BITMAP)
    shared = _meeting(bitmaps, groups).select("lang", "chunk", "i", "j", "own", "source_key", "n", "p", "p0", "bits")
    joint = shared.groupBy("lang", "chunk", "i", "j").applyInArrow(lambda g: _joint(g), _SUMS)
    levels = flat.groupBy("lang", "source_key", "n").agg(F.count(F.lit(1)).alias("n_terms"))
    every = levels.union(groups.select("lang", "source_key", none.alias("n"), none.alias("n_terms")))
    alone = _meeting(every, groups).select("lang", "i", "j", "own", "source_key", "n", "n_terms", "p", "p0", "terms").groupBy(
        "lang", "i", "j"
    ).applyInArrow(lambda g: _alone(g), _SUMS)
    # parts are longs modulo 2^64, and so is their sum
    half, whole = (F.lit(str(2**x)).cast("decimal(20,0)") for x in (63, 64))
    value = F.pmod(F.sum(F.col("value").cast("decimal(20,0)")) + half, whole) - half
    pairs = joint.union(alone).groupBy("lang", "source_key", "other_key").agg(value.cast("long").alias("value"))
    other = groups.select("lang", F.col("source_key").alias("other_key"), F.col("source").alias("item"))
    pairs = pairs.join(groups.select("lang", "source_key", "source"), ["lang", "source_key"]).join(other, ["lang", "other_key"])
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))
    p, q = F.col("p"), F.col("q")
    terms = (
        flat.join(groups.drop("blocks", "own"), ["lang", "source_key"])
        .select(
            "lang", "source", F.col("term").alias("item"), _share(F.col("n"), F.col("occurrences"), F.col("terms")).alias("p"),
            _share(F.col("total"), F.col("lang_occurrences"), F.col("terms")).alias("q"),
        )
        .where("p > q")
        .select("lang", "source", F.lit("term").alias("part"), "item", _div((p - q) * (p - q), q).alias("value"))
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= top)
    )
    return pairs.union(terms)
