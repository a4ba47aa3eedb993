"""Document fingerprints: a digest of bucket quartiles.

Byte triplets from a sliding window of five bytes are hashed into 128 buckets
and counted. The digest has, for every bucket, which quartile of the counts it
lies in (two bits), and a header with the length on a log scale and the ratios
of the quartiles. Two digests are compared by a difference that sums the
distances of their quartiles and headers, and likeness falls from 1 to 0 as the
difference grows to a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix

BUCKETS = 128
# a difference of this much, or more, is likeness 0
BOUND = 300
# of a window of five bytes: the places of each triplet (fixed values)
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))

_FIRST, _SECOND, _THIRD = (
    mix(np.arange(256, dtype=np.uint64) + np.uint64(256 * k)).astype(np.uint32) for k in range(3)
)


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of 35 bytes per text: length, two quartile ratios, 32 bytes of quartiles."""
    n_texts, lengths = len(offsets) - 1, np.diff(offsets)
    counts = np.zeros((n_texts, BUCKETS), np.int64)
    n = len(data)
    owner = np.repeat(np.arange(n_texts, dtype=np.int64) * BUCKETS, lengths)
    room = np.repeat(offsets[1:], lengths) - np.arange(n)  # bytes from here to the text's end
    if n:
        a, b, c = _FIRST[data], _SECOND[data], _THIRD[data]
        for k, (_, j, last) in enumerate(TRIPLETS):
            if n <= last:
                continue
            m = n - last
            h = (a[:m] ^ b[j : j + m] ^ c[last : last + m]) * np.uint32(2 * k + 0x9E3779B1)
            bucket = owner[:m] + (h >> np.uint32(25))
            counts += np.bincount(bucket[room[:m] > last], minlength=n_texts * BUCKETS).reshape(n_texts, BUCKETS)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    level = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    packed = level.reshape(n_texts, BUCKETS // 4, 4)
    body = packed[..., 0] | packed[..., 1] << 2 | packed[..., 2] << 4 | packed[..., 3] << 6
    scale = np.round(np.log1p(lengths) / np.log(1.1)).astype(np.int64)
    top = np.maximum(q3, 1)
    header = np.stack([np.minimum(scale, 255), 15 * q1 // top, 15 * q2 // top], axis=1)
    return np.concatenate([header, body], axis=1).astype(np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of digests, row by row: header steps and quartile steps.

    A bucket counts its steps between quartiles, and from the first to the last
    quartile twice as much; a length step counts one, beyond two steps four.
    """
    x, y = a[:, 3:], b[:, 3:]
    total = np.zeros(len(a), np.int64)
    for shift in (0, 2, 4, 6):
        d = np.abs(((x >> shift) & 3).astype(np.int64) - ((y >> shift) & 3))
        total += np.where(d == 3, 6, d).sum(1)
    length = np.abs(a[:, 0].astype(np.int64) - b[:, 0])
    total += np.where(length > 2, 4 * length, length)
    for k in (1, 2):
        d = np.abs(a[:, k].astype(np.int64) - b[:, k])
        total += np.where(d > 1, 4 * d, d)
    return total


def likeness(a: np.ndarray, b: np.ndarray, bound: int = BOUND) -> np.ndarray:
    """1 for equal digests, down to 0 at a difference of ``bound``."""
    return 1.0 - np.minimum(difference(a, b), bound) / bound


def digests_of(texts: list[bytes]) -> np.ndarray:
    """Digests of many texts, in runs of bounded size."""
    out, first = [np.zeros((0, 3 + BUCKETS // 4), np.uint8)], 0
    while first < len(texts):
        end, size = first, 0
        while end < len(texts) and (end == first or size + len(texts[end]) <= SLICE_BYTES):
            size += len(texts[end])
            end += 1
        run = texts[first:end]
        out.append(digests(np.frombuffer(b"".join(run), np.uint8), np.cumsum([0, *map(len, run)])))
        first = end
    return np.concatenate(out)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every row; a NULL text counts as empty."""
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = digests_of([t.as_py().encode() for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r.tobytes().hex() for r in found], pa.string())],
                names=["doc_id", "fingerprint"],
            )

    return given.mapInArrow(compute, given.select("doc_id").schema.add("fingerprint", "string"))


def in_runs(docs: DataFrame, rows_per_run: int = 500, most_runs: int = 20_000) -> DataFrame:
    """Rows (run, extra, doc_id, tie, text), with runs in descending order of doc_id.

    Runs are cut at quantiles of the id, found from the id column alone; what
    comes to the driver, and is broadcast, is an id per run, ``most_runs`` at most. The
    first row of a run comes a second time, as ``extra``, at the end of the run
    before it (that of the first run at the end of the last), so each run has the
    successor of each of its rows. NULL ids come last; rows of one id are in the
    order of a hash of their text, and repeated rows are interchangeable.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    runs = max(1, min(docs.select("doc_id").count() // rows_per_run, most_runs))
    points = F.array(*[F.lit(i / runs) for i in range(1, runs)] or [F.lit(0.5)])
    quantiles = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), points, 100 * runs)).first()[0]
    # an id and its double order alike, so a cut between doubles never parts equal ids
    cuts = [-np.inf, *sorted(set(quantiles or [0.0])), np.inf]
    place = Bucketizer(splits=cuts, inputCol="order", outputCol="bucket", handleInvalid="keep")
    rows = place.transform(texts.withColumn("order", F.coalesce(F.col("doc_id").cast("double"), F.lit(-np.inf))))
    rows = rows.select(
        F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(F.lit(len(cuts)) - F.col("bucket")).cast("int").alias("run"),
        "doc_id",
        F.xxhash64("text").alias("tie"),
        "text",
    )
    # a run's head has its largest id and, of that, the smallest tie
    first = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", F.bitwise_not("tie")))
    heads = sorted((r["run"], r["head"][1], ~r["head"][2]) for r in rows.groupBy("run").agg(first.alias("head")).collect())
    earlier = [(run, heads[i - 1][0], doc_id, tie) for i, (run, doc_id, tie) in enumerate(heads)]
    copies = spark.createDataFrame(earlier, "run int, earlier int, head_id long, head_tie long")
    leads = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct("run", F.lit(False).alias("extra"))
    copy = F.struct(F.col("earlier").alias("run"), F.lit(True).alias("extra"))
    placed = rows.join(F.broadcast(copies), "run").select(
        F.explode(F.when(leads, F.array(own, copy)).otherwise(F.array(own))).alias("place"), "doc_id", "tie", "text"
    )
    return placed.select("place.*", "doc_id", "tie", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The next document is that of the next smaller id;
    after the last comes the first; the only document is its own next. A NULL
    text counts as empty. The text is shuffled once.
    """
    runs = in_runs(docs)
    order = [F.col("run"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("tie")]
    dealt = runs.repartition("run").sortWithinPartitions(*order)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )

    def scored(rows: list[tuple]) -> pa.RecordBatch:
        """Of consecutive rows (doc_id, text), all but the last one."""
        texts = [t for _, t in rows]
        changed = [edited(t, u).encode() for t, u in zip(texts, texts[1:])]
        own = digests_of([t.encode() for t in texts])
        new = digests_of(changed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([r.tobytes().hex() for r in own[:-1]], pa.string()),
                pa.array([r.tobytes().hex() for r in new], pa.string()),
                pa.array(likeness(own[:-1], new)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, run, closed = 0, None, False
        for batch in batches:
            columns = [batch.column(c) for c in ("run", "extra", "doc_id", "text")]
            for i in range(batch.num_rows):
                r, extra, doc_id, text = (c[i].as_py() for c in columns)
                if r != run:
                    held, size, run, closed = [], 0, r, False
                if closed:
                    continue
                held.append((doc_id, text))
                size += len(text)
                closed = extra  # repeated rows at a run's head come as several copies
                if extra or size > SLICE_BYTES:
                    if len(held) > 1:
                        yield scored(held)
                        held = held[-1:]
                    size = len(held[-1][1])

    return dealt.mapInArrow(compute, schema)
