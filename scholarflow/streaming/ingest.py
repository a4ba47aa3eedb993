"""Incremental ingest: handle each id once across runs."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scholarflow.functions import text as X

if TYPE_CHECKING:
    from scholarflow.sources.stores import BucketStore

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a
    session whose tasks run inside the driver gets a temporary folder; any other
    one is refused, since a folder of one machine would tear staged tables apart.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    folder = tempfile.mkdtemp(prefix="scholarflow-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def id_stream(
    spark: SparkSession, path: str, schema: str, column: str, *,
    glob: str | None = None, files_per_batch: int = 1000,
) -> DataFrame:
    """Stream of ids (as text) from parquet files that arrive in a directory."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path).select(X.strip(F.col(column).cast("string")).alias("id"))


def ingest_new_ids(
    stream: DataFrame, table: str, checkpoint: str, *,
    fetch: Callable[[DataFrame], DataFrame] = lambda ids: ids,
) -> None:
    """Append what is new in ``stream`` to the parquet ``table``, then stop.

    Which ids are known is the stream's state, kept under ``checkpoint`` and split
    by a hash of the id: a batch touches the state of its own ids only, and
    stored rows are not read again. (With the RocksDB state store the state need
    not fit in memory.) A batch owns the directory batch=<n> and overwrites
    it, so a replay after a failure writes the same rows again and not twice.
    ``fetch`` turns new ids into the rows to store (they keep the column ``id``).
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        fetch(batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    new = stream.where(F.coalesce("id", F.lit("")) != "").dropDuplicates(["id"])
    query = (
        new.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class _Latest(StatefulProcessor):
    """Lets a key's record pass if it is newer than all before; its time is the state."""

    def __init__(self, written: str, kind: str) -> None:
        self.written, self.kind = written, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", f"written {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        known = self.newest.get()
        best, top = None, known[0] if known is not None else None
        for batch in rows:
            batch = batch[batch[self.written].notna()]
            if not len(batch):
                continue
            # of equally new records the first stays
            row = batch.loc[[batch[self.written].idxmax()]]
            if top is None or row[self.written].iloc[0] > top:
                best, top = row, row[self.written].iloc[0]
        if best is not None:
            plain = top.to_pydatetime() if isinstance(top, pd.Timestamp) else getattr(top, "item", lambda: top)()
            self.newest.update((plain,))
            yield best

    def close(self) -> None:
        pass


def ingest_latest(stream: DataFrame, store: BucketStore, checkpoint: str, *, stage: str) -> None:
    """Take the records of ``stream`` into ``store``, then stop: of each key the newest stays.

    The store has one key column and one column ``written``. The time of a key's
    newest record is kept as state under ``checkpoint``, split by key: an older
    record that comes late is dropped before it reaches the store, in the same
    run or a later one, and of several new ones only the newest goes there. A
    batch rewrites the buckets of its keys; a replayed one writes the same again.
    Records without key or time are dropped.
    """
    spark = stream.sparkSession
    (key,), (written,) = store.keys, store.written
    kind = stream.schema[written].dataType.simpleString()
    known = stream.where(F.col(key).isNotNull() & F.col(written).isNotNull())
    newest = known.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Latest(written, kind), outputStructType=stream.schema, outputMode="Update", timeMode="None",
    )

    def put(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, stage=f"{stage}/batch={batch_id}")

    usual = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # the one that keeps typed state
    try:
        query = (
            newest.writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(_PROVIDER, usual)
    query.awaitTermination()
