"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarflow.streaming.ingest import work_dir

# bytes of text that one numpy pass holds at a time in a task
SLICE_BYTES = 2 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

# 64-bit constants of the mixing function below (fixed values)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_SHIFT = (np.uint64(30), np.uint64(27), np.uint64(31))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below the one that all nodes share (``spark.checkpoint.dir``)."""
    return f"{work_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame, batch_bytes: str | None = None) -> DataFrame:
    """``df`` through a Parquet table in the shared folder.

    It is computed once however often it is read, and survives lost executors.
    The folder belongs to the application, like a checkpoint: whoever owns
    ``spark.checkpoint.dir`` clears it when the application ends.

    ``batch_bytes`` bounds, for this table, what goes to a Python worker at a
    time; rows with several texts fill batches of the usual size with too much.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    usual = spark.conf.get(_BATCH_BYTES)
    if batch_bytes:
        spark.conf.set(_BATCH_BYTES, batch_bytes)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH_BYTES, usual)
    return spark.read.schema(df.schema).parquet(path)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``task`` for mapInArrow, which then gives freed memory back to the system.

    Workers live on for later tasks, also those of other stages, which should not
    find the memory taken that this one needed at its peak.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)

    return run


def text_crc(doc_id: str | Column) -> Column:
    """crc32 of a document's id as text, unsigned; a NULL id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def slices(
    batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes.

    Yields (first row, end row, bytes, offsets): row ``first + i`` has the bytes
    ``offsets[i]:offsets[i + 1]``. A NULL text has no bytes. A row is never cut,
    so one very long text makes a run of its own.
    """
    array = batch.column(batch.schema.get_field_index(column))
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    buffers = array.buffers()
    if len(array) == 0:
        return
    offsets = np.frombuffer(buffers[1], kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(array):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), len(array))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor, shift, multiply) over unsigned arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _SHIFT[0])) * _MIX[0]
        x = (x ^ (x >> _SHIFT[1])) * _MIX[1]
        return x ^ (x >> _SHIFT[2])


def _is_space() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


IS_SPACE = _is_space()

# A-Z to a-z, other bytes as they are
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        take = min(done, n - done)
        with np.errstate(over="ignore"):
            out[done : done + take] = out[:take] * step
        done += take
    return out


_POWER_CACHE: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64 for the fixed odd base b, or for its inverse."""
    have = _POWER_CACHE.get(inverse)
    if have is None or len(have) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        have = _powers(max(n, 1 << 16), base)
        if n > (4 << 20):  # do not keep what one huge text needed
            return have
        _POWER_CACHE[inverse] = have
    return have[:n]


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Polynomial sums of all prefixes; differences give hashes of any substring."""
    with np.errstate(over="ignore"):
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans ``starts:ends``, equal for equal contents."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts] + (ends - starts).astype(np.uint64))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUE[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts: (starts, ends, first word of each text).

    The third array has one more entry than there are texts. No word spans two
    texts, also where one text ends and the next begins without white space.
    """
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] ... starts[i] + lengths[i] - 1``, one run after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    shift = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - shift, lengths)
