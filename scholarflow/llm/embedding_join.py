"""Links between near embeddings by an epsilon grid order join.

Vectors of equal direction components are one class. On the unit sphere a cosine of
at least c is a distance of at most epsilon = sqrt(2 - 2 c), so a grid of that side over
the leading principal axes puts linked vectors into the same or neighbouring cells.
Classes are sorted by their cells, axis by axis, and the sequence is cut into
intervals. Intervals are joined from the whole sequence down, halving both sides,
and a pair of intervals is dropped where the boxes of their coordinates are further
apart than epsilon; since projections only shorten distances, no link is lost. What
is left at the bottom meets in tasks of two blocks, which go on halving and multiply
the smallest intervals in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .components import components

# leading principal axes; vectors that the axes are fitted to
AXES, FIT = 16, 4096
# vectors of a block, and of the smallest interval inside a task
BLOCK, TILE = 8192, 1024
# cosines that are so near to the threshold are computed anew, with exact sums
NEAR = 1e-9
_PART = 1 << 33  # of monotonically_increasing_id: rows of a partition


def _units(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, vectors, unit vectors) for each length of the lists, in double precision."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = values[offsets[rows][:, None] + np.arange(d)]
        scaled = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
        yield rows, x, scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _projected(units: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Coordinates on the axes; where none fit, the leading components."""
    if axes is not None and axes.shape[1] == units.shape[1]:
        found = units @ axes.T
    else:
        found = units[:, :AXES]
    return np.pad(found, ((0, 0), (0, AXES - found.shape[1])))


def principal_axes(classes: DataFrame) -> np.ndarray | None:
    """The leading principal axes of at most ``FIT`` vectors, those of the least hashes.

    They steer how much is skipped, never what is found. Of several lengths of
    vectors, the most frequent one of the sample gets axes.
    """
    sample = classes.orderBy(F.xxhash64("vector"), "vec_id").limit(FIT).select("vector").toArrow()
    if not sample.num_rows:
        return None
    units = max((u for _, _, u in _units(sample.column("vector").combine_chunks())), key=len)
    centred = units - units.mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    return np.ascontiguousarray(axes[:, ::-1][:, :AXES].T)


def _sequence(classes: DataFrame, axes: np.ndarray | None, side: float) -> DataFrame:
    """at, vec_id, copies, vector, coordinates of each class, numbered in grid order."""
    kind = dict(classes.dtypes)
    schema = f"vec_id {kind['vec_id']}, copies long, vector {kind['vector']}, cells binary, coordinates array<double>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vectors = batch.column("vector")
            coordinates, cells = np.zeros((n, AXES)), np.zeros((n, AXES + 4), np.uint8)
            for rows, _, units in _units(vectors):
                found = _projected(units, axes)
                coordinates[rows] = found
                cells[rows, :4] = np.frombuffer(int(units.shape[1]).to_bytes(4, "big"), np.uint8)
                cells[rows, 4:] = np.clip(np.floor(found / side) + 128, 0, 255)
            flat = pa.ListArray.from_arrays(np.arange(0, AXES * (n + 1), AXES, dtype=np.int32), pa.array(coordinates.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("copies"), vectors, pa.array([c.tobytes() for c in cells], pa.binary()), flat],
                names=["vec_id", "copies", "vector", "cells", "coordinates"],
            )

    order = ["cells", "vec_id", "vector"]
    placed = classes.select("vec_id", "copies", "vector").mapInArrow(place, schema)
    dealt = staged(
        placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("cells")
        .withColumn("row", F.monotonically_increasing_id())
    ).withColumn("part", F.expr(f"row div {_PART}"))
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    at = F.col("offset") + F.col("row") % _PART
    return dealt.join(offsets, "part").select(at.alias("at"), "vec_id", "copies", "vector", "coordinates")


def _boxes(sequence: DataFrame) -> list[DataFrame]:
    """(id, low, high) of the blocks, of pairs of blocks, and so on up to one interval."""
    axis = range(AXES)
    level = staged(
        sequence.groupBy(F.expr(f"at div {BLOCK}").alias("id")).agg(
            F.array(*[F.min(F.col("coordinates")[i]) for i in axis]).alias("low"),
            F.array(*[F.max(F.col("coordinates")[i]) for i in axis]).alias("high"),
        )
    )
    levels = [level]
    n = level.count()
    while n > 1:
        level = staged(
            level.groupBy(F.expr("id div 2").alias("id")).agg(
                F.array(*[F.min(F.col("low")[i]) for i in axis]).alias("low"),
                F.array(*[F.max(F.col("high")[i]) for i in axis]).alias("high"),
            )
        )
        levels.append(level)
        n = -(-n // 2)
    return levels


def _meetings(levels: list[DataFrame], reach: float) -> DataFrame:
    """The pairs (i, j), i <= j, of blocks whose boxes, and those of all intervals above them,
    are within ``reach``."""
    pairs = levels[-1].select(F.col("id").alias("i"), F.col("id").alias("j"))
    halves = lambda c: F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)).alias(c)
    for boxes in reversed(levels[:-1]):
        pairs = pairs.select(halves("i"), "j").select("i", halves("j")).where("i <= j")
        first = boxes.select(F.col("id").alias("i"), F.col("low").alias("low_i"), F.col("high").alias("high_i"))
        second = boxes.select(F.col("id").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
        gap = F.expr(
            "aggregate(sequence(0, size(low_i) - 1), 0D, (s, k) -> s + "
            "power(greatest(low_i[k] - high_j[k], low_j[k] - high_i[k], 0D), 2))"
        )
        pairs = pairs.join(first, "i").join(second, "j").where(gap <= reach * reach).select("i", "j")
    return pairs


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows the smallest label of their component, by hooking and shortening."""
    while True:
        left, right = label[a], label[b]
        apart = left != right
        if not apart.any():
            return
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        hook = np.arange(len(label))
        np.minimum.at(hook, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(further := hook[hook], hook):
            hook = further
        label[:] = hook[label]


class _Meeting:
    """Links among the vectors of two blocks: counts of linked vectors, and labels of components."""

    def __init__(self, group: pa.Table, least: float, axes: np.ndarray | None) -> None:
        self.least, self.reach = least, math.sqrt(max(0.0, 2 - 2 * least)) + NEAR
        self.at, self.copies = group.column("at").to_numpy(), group.column("copies").to_numpy()
        side = group.column("side").to_numpy()
        self.label, self.links = np.arange(len(side)), np.zeros(len(side), np.int64)
        one_block = not side.any()
        for rows, raw, units in _units(group.column("vector").combine_chunks()):
            self.raw, self.units, self.rows = raw, units, rows
            self.coordinates = _projected(units, axes)
            one, two = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
            self._join(one, one if one_block else two)

    def _far(self, one: np.ndarray, two: np.ndarray) -> bool:
        x, y = self.coordinates[one], self.coordinates[two]
        gap = np.maximum(np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)), 0)
        return bool((gap * gap).sum() > self.reach * self.reach)

    def _join(self, one: np.ndarray, two: np.ndarray) -> None:
        if not len(one) or not len(two) or self._far(one, two):
            return
        if len(one) <= TILE and len(two) <= TILE:
            self._multiply(one, two)
        elif one is two:
            half = len(one) // 2
            low, high = one[:half], one[half:]
            self._join(low, low)
            self._join(low, high)
            self._join(high, high)
        else:
            for a in np.array_split(one, 2 if len(one) > TILE else 1):
                for b in np.array_split(two, 2 if len(two) > TILE else 1):
                    self._join(a, b)

    def _multiply(self, one: np.ndarray, two: np.ndarray) -> None:
        cosine = self.units[one] @ self.units[two].T
        hit = cosine >= self.least
        for x, y in zip(*np.nonzero(np.abs(cosine - self.least) < NEAR)):
            hit[x, y] = _cosine(self.raw[one[x]], self.raw[two[y]]) >= self.least
        if one is two:
            np.fill_diagonal(hit, False)
        x, y = np.nonzero(hit)
        if not len(x):
            return
        a, b = self.rows[one], self.rows[two]
        # far fewer than 2^53 vectors: sums in double are exact
        self.links[a] += (hit @ self.copies[b].astype(np.float64)).astype(np.int64)
        if one is not two:
            self.links[b] += (self.copies[a].astype(np.float64) @ hit).astype(np.int64)
        _unite(self.label, a[x], b[y])

    def table(self) -> pa.Table:
        met = np.flatnonzero(self.links)
        return pa.table({"node": self.at[met], "n": self.links[met], "to": self.at[self.label[met]]})


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    """The cosine with correctly rounded sums."""
    x, y = x / np.abs(x).max(), y / np.abs(y).max()
    return math.fsum((x * y).tolist()) / math.sqrt(math.fsum((x * x).tolist()) * math.fsum((y * y).tolist()))


def near_vectors(vectors: DataFrame, *, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Two rows are linked where the cosine of their embeddings, in double precision,
    is at least ``least``, which must be above 0; n_links counts the other rows that a row is linked with,
    component_id is the smallest vec_id that links reach, its own included, and ``kept``
    says that it is its own. Embeddings that are NULL, empty, zero or hold a NULL, NaN or
    infinite component are linked with nothing, and so are those of different
    lengths. Rows that share a vec_id are vectors of their own. A row without vec_id is
    linked with nothing, has no component_id and is kept. Other columns are not read.
    """
    kind = dict(vectors.dtypes)["embedding"]
    number = "float" if kind == "array<float>" else "double"
    vector = F.transform(F.col("embedding").cast(f"array<{number}>"), lambda x: x + F.lit(0).cast(number))  # -0 is 0
    given = vectors.select("vec_id", vector.alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False)))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    given = given.withColumn("vector", F.when(usable, F.col("vector")))
    classes = staged(
        given.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    )
    axes = principal_axes(classes)
    reach = math.sqrt(max(0.0, 2 - 2 * least))
    sequence = staged(_sequence(classes, axes, reach or 1.0))
    pairs = staged(_meetings(_boxes(sequence), reach + NEAR))
    sides = pairs.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("block", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    blocks = sequence.select(F.expr(f"at div {BLOCK}").alias("block"), "at", "copies", "vector")
    met = sides.join(blocks, "block").select("i", "j", "side", "at", "copies", "vector")
    found = staged(
        met.groupBy("i", "j").applyInArrow(
            lambda group: _Meeting(group, least, axes).table(), "node long, n long, to long"
        )
    )
    reached = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = staged(
        sequence.select(F.col("at").alias("node"), "vec_id", "copies").join(reached, "node", "left").join(counts, "node", "left")
        .select("node", "vec_id", F.coalesce("component", "node").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    least_id = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    result = named.join(least_id, "component").join(sequence.select(F.col("at").alias("node"), "vector"), "node")
    out = given.join(result.select("vector", "n_links", "component_id"), "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
