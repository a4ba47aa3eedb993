"""MinHash near-dedup with circulant signatures, banding and exact verification.

A signature needs two permutations of the 64-bit numbers only: the first one
scatters a shingle's hash, and coordinate k is the smallest value that the second
one gives to the scattered hashes shifted circularly by k. Bands of coordinates
name buckets. Texts with equal shingle sets are one class, and only its
representative goes on. In each bucket all members are held against its smallest
member (a star), not against each other. Where that leaves a bucket in several
components, its members are compared across components, in blocks, by a product of
their full sets, and only links that join components come out. Every link rests on
the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    LOWER, byte_values, mix, prefix_hashes, slices, span_hashes, staged, tidy, words,
)
from .components import components

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
# two sketches whose agreement lies this many standard deviations below the
# similarity that is sought are no candidates (chance of a loss below 1e-9)
DEVIATIONS = 6.0
# a block has so many documents, or shingles, in the mean
BLOCK, BLOCK_SHINGLES = 1000, 400_000
COLUMNS = 4096
BATCH_BYTES = "8m"
_SCATTER = np.uint64(0xD1B54A32D192ED03)
_SECOND = np.uint64(0x8CB92BA72F3D8DD7)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A shingle is k consecutive words after lower-casing A-Z; a text of fewer
    words is one shingle, and a text without words has none.
    """
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    word = span_hashes(prefix_hashes(byte_values(data)), starts, ends)
    prefix = prefix_hashes(word)
    n = np.diff(first)
    at = np.arange(max(len(word) - k + 1, 0))
    shingles = span_hashes(prefix, at, at + k)
    out = []
    for i in range(len(offsets) - 1):
        if n[i] >= k:
            out.append(np.unique(shingles[first[i] : first[i + 1] - k + 1]))
        elif n[i]:
            out.append(span_hashes(prefix, first[i : i + 1], first[i + 1 : i + 2]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Circulant MinHash: one row of coordinates per non-empty set."""
    values = mix(np.concatenate(sets) ^ _SCATTER)  # the first permutation
    at = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(COORDINATES):  # the second one, after a circular shift by k
            out[:, k] = np.minimum.reduceat(mix(values + np.uint64(k)), at)
    return out


def _described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, key_a, key_b (of the set), bands, sketch of every row."""
    given = docs.select(F.col("doc_id").cast("long"), "text")
    schema = "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, sketch binary"

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in slices(batch, "text", 1 << 19):
                sets = shingle_sets(data, offsets, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                size = np.array([len(s) for s in sets], np.int64)
                keys = np.zeros((2, hi - lo), np.uint64)
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                sketch = np.zeros((hi - lo, COORDINATES), np.uint8)
                if full:
                    held = [sets[i] for i in full]
                    at = np.cumsum([0, *[len(s) for s in held[:-1]]])
                    joined = np.concatenate(held)
                    with np.errstate(over="ignore"):
                        for row, seed in zip(keys, (_SCATTER, _SECOND)):
                            row[full] = np.add.reduceat(mix(joined + seed), at)
                        sig = signatures(held)
                        code = np.broadcast_to(band, (len(full), BANDS)).copy()
                        for j in range(ROWS):
                            code = mix(code ^ sig[:, j::ROWS])
                        bands[full] = code
                    sketch[full] = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(size),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.ListArray.from_arrays(
                            np.arange(0, BANDS * (hi - lo + 1), BANDS, dtype=np.int32), pa.array(bands.ravel().view(np.int64))
                        ),
                        pa.array([r.tobytes() for r in sketch], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "key_a", "key_b", "bands", "sketch"],
                )

    return given.mapInArrow(tidy(describe), schema)


def _agreement_needed(percent: int) -> int:
    s = percent / 100
    low = s - DEVIATIONS * math.sqrt(s * (1 - s) / COORDINATES)
    return max(1, math.ceil(low * COORDINATES))


def _alike(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that allow the similarity: the smaller set may be the intersection."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _sketched(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda x: nodes.select(
        F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(
        (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    )
    need = _agreement_needed(percent)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("s_a", "s_b")
            )
            good = pa.array((x == y).sum(1) >= need)
            yield batch.select(["a", "b"]).filter(good)

    return both.select("a", "b", "s_a", "s_b").mapInArrow(tidy(check), "a long, b long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents whose full shingle sets reach the similarity."""
    pairs = staged(pairs)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # shuffled at every size: how many documents have pairs depends on the data alone
    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi")
    first = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(second, "b").join(first, "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            a, text_a = batch.column("a").to_numpy(), batch.column("text_a")
            for lo, hi, data, offsets in slices(batch, "text_b"):
                for i, other in enumerate(shingle_sets(data, offsets, k), lo):
                    text = text_a[i].as_py() or ""
                    if last != (a[i], text):
                        raw = np.frombuffer(text.encode(), np.uint8)
                        last, last_set = (a[i], text), shingle_sets(raw, np.array([0, len(raw)]), k)[0]
                    if _alike(len(last_set), len(other), percent):
                        common = len(np.intersect1d(last_set, other, assume_unique=True))
                        good[i] = 100 * common >= percent * (len(last_set) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(tidy(check), "a long, b long").distinct()


def _common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets, by a matrix
    product over the shingles, some columns at a time."""
    sets = left + right
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    kinds, column, often = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    place = np.cumsum(often > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    n = int((often > 1).sum())
    for first in range(0, n, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        dense = np.zeros((len(sets), min(COLUMNS, n - first)), np.float32)
        dense[row[lo:hi], column[lo:hi] - first] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out.astype(np.int64)


def _joining(links: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Of links between rows those that join components, one after another."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for x, y in links.tolist():
        a, b = find(int(component[x])), find(int(component[y]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _across(buckets: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket that the stars left in different
    components.

    Buckets of several components go by the component that most of their members
    have, so that a document with many buckets is mostly in one group. Members of
    a group are dealt into blocks, each pair of blocks meets in one task, which
    holds two blocks of texts and gives fewer links than it has members.
    """
    named = staged(
        buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    )
    per_component = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = (
        per_component.groupBy("bucket")
        .agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", -F.col("component"))).alias("most"))
        .where("size > 2 and kinds > 1")
        .select("bucket", (-F.col("most")[F.lit("col2")]).alias("root"))
    )
    members = staged(
        named.join(staged(mixed), "bucket").select("root", "node", "component").distinct().join(nodes.select("node", "n_shingles"), "node")
    )
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    groups = staged(members.groupBy("root").agg(blocks.alias("blocks")))
    dealt = members.join(groups, "root").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(
        members.select("node").distinct().hint("merge"), "node", "left_semi"
    )
    spread = dealt.join(texts.hint("merge"), "node").select(
        "root", "node", "component", "own", "text",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component", "own", "text",
    )

    def meet(group: pa.Table) -> pa.Table:
        node, component, own = (group.column(c).to_numpy() for c in ("node", "component", "own"))
        raw = [(t or "").encode() for t in group.column("text").to_pylist()]
        sets: list[np.ndarray] = []
        for first in range(0, len(raw), 100):
            run = raw[first : first + 100]
            sets += shingle_sets(np.frombuffer(b"".join(run), np.uint8), np.cumsum([0, *map(len, run)]), k)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        both = _common_shingles([sets[x] for x in left], [sets[x] for x in right])
        size = np.array([len(x) for x in sets], np.int64)
        either = size[left][:, None] + size[right][None] - both
        linked = (100 * both >= percent * either) & (both > 0) & (component[left][:, None] != component[right][None])
        x, y = np.nonzero(linked)
        links = _joining(np.stack([left[x], right[y]], axis=1), component)
        ends = [sorted((int(node[x]), int(node[y]))) for x, y in links]
        return pa.table({"a": pa.array([e[0] for e in ends], pa.int64()), "b": pa.array([e[1] for e in ends], pa.int64())})

    return spread.groupBy("root", "i", "j").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``.

    Documents are linked whose sets of ``shingle``-word shingles (see
    ``shingle_sets``) have 100 * intersection >= ``percent`` * union; component_id
    is the smallest doc_id that links reach, and ``kept`` says that it is the
    row's own. Texts without words, NULL texts among them, are linked with
    nothing. Rows that share a doc_id are one document here. A row without doc_id
    has nothing to be named by: it gets a NULL component_id and is kept. Other
    columns are not read.

    The banding misses a pair of similarity 0.8 with a chance of 5e-8.
    """
    found = staged(_described(docs, shingle), BATCH_BYTES)
    named = found.where("n_shingles > 0 and doc_id is not null")
    classes = staged(
        named.groupBy("key_a", "key_b").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        )
    )
    nodes = classes.select("node", "n_shingles", "sketch")
    members = classes.select(F.explode("bands").alias("bucket"), "node")
    stars = staged(
        members.groupBy("bucket").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1")
        .select("bucket", "center")
    )
    buckets = staged(members.join(stars, "bucket"))
    pairs = buckets.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = staged(_verified(_sketched(pairs, nodes, percent), docs, shingle, percent), BATCH_BYTES)
    # rows of one id with different sets are one document: their classes meet here
    same_id = named.groupBy("doc_id").agg(F.min("key_a").alias("lo"), F.max("key_a").alias("hi")).where("lo <> hi").select("doc_id")
    torn = (
        named.join(same_id, "doc_id").join(classes.select("key_a", "key_b", "node"), ["key_a", "key_b"])
        .select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    )
    links = links.union(torn)
    labels = components(links)
    across = _across(buckets.select("bucket", "node"), labels, nodes, docs, shingle, percent)
    further = staged(across, BATCH_BYTES)
    if not further.isEmpty():
        labels = components(links.union(further))
    roots = staged(
        classes.join(labels, "node", "left").select("key_a", "key_b", F.coalesce("component", "node").alias("root"))
    )
    linked = found.select("doc_id", "n_shingles", "key_a", "key_b").withColumn(
        "linkable", (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    )
    out = linked.join(roots, ["key_a", "key_b"], "left")
    component = F.when(F.col("linkable"), F.col("root")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def first_of_each(docs: DataFrame, *, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all columns, of one document per group.

    Kept is the document of the group's smallest doc_id. Of several rows of that
    doc_id all stay, since they are one document here. Rows without doc_id stay.
    """
    found = near_duplicates(docs, shingle=shingle, percent=percent)
    gone = staged(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone.hint("merge"), F.col("doc_id") == F.col("_gone"), "left_anti")
