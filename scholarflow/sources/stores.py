"""Tables that are written again and again: by bucket, as an index, as a log.

A ``BucketStore`` holds one row per key in directories by a hash of the key. A write
reads and rewrites the buckets of its own keys and leaves the files of all others
as they are, so its cost follows the write, not the table. An ``IdIndex`` is a
bucketed and sorted table of id pairs: a join shuffles the requests only, and a
lookup of a few ids opens their buckets only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarflow.operators.papers import latest_by
from scholarflow.operators.scale import staged

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketStore:
    """One row per key below ``path``, in ``buckets`` directories.

    ``buckets`` belongs to the table: it is part of the directories' names, and
    another number is refused. ``written`` names the columns that tell which of two
    rows of a key is newer; without them every write is newer than what is stored. As with any
    directory of files, one writer at a time.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int
    written: tuple[str, ...] = ()

    @property
    def _rows(self) -> str:
        return f"{self.path.rstrip('/')}/of={self.buckets}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def read(self) -> DataFrame | None:
        """The stored rows, without order; None before the first write."""
        try:
            found = self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        others = found.where(F.col("of") != self.buckets).select("of").limit(1).collect()
        if others:
            raise ValueError(f"{self.path} has {others[0][0]} buckets, not {self.buckets}")
        return found.drop("of")

    def find(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the given keys, from their buckets only."""
        keys = keys.select(*self.keys).distinct()
        return self._stored(self._touched(keys)).drop(BUCKET).join(keys, list(self.keys), "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows: at most as many as there are."""
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]

    def _stored(self, touched: list[int]) -> DataFrame | None:
        found = self.read()
        return None if found is None else found.where(F.col(BUCKET).isin(touched))

    def upsert(self, rows: DataFrame, *, stage: str) -> int:
        """Put ``rows`` in the place of stored rows of their keys; the number of buckets written.

        Of several rows of a key the newest stays, also where that one is stored
        already, so a write may come late or twice. What is to be written is staged
        in the folder ``stage`` first: if the job is lost while buckets are being
        replaced, the same call with the same rows repairs them.
        """
        columns = [*self.keys, *[c for c in rows.columns if c not in self.keys]]
        rows = rows.select(*columns)
        order = list(self.written)
        if order:
            rows = latest_by(rows, list(self.keys), order)
        new = staged(rows, f"{stage}/new")
        touched = self._touched(new)
        if not touched:
            return 0
        old = self._stored(touched)
        both = new.withColumn("_gen", F.lit(1))
        if old is not None:
            both = both.unionByName(old.drop(BUCKET).withColumn("_gen", F.lit(0)), allowMissingColumns=True)
        merged = latest_by(both, list(self.keys), [*order, "_gen"]).drop("_gen").withColumn(BUCKET, self._bucket())
        merged = staged(merged, f"{stage}/merged")
        (
            merged.repartition(BUCKET).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self._rows)
        )
        return len(touched)


@dataclass(frozen=True)
class IdIndex:
    """A stored index from ids to ids: the table ``name`` over the files below ``path``.

    Any session can open it again by its path and its number of buckets. Each ``value``
    is there once.
    """

    spark: SparkSession
    name: str
    buckets: int

    @classmethod
    def write(cls, index: DataFrame, name: str, path: str, *, buckets: int) -> IdIndex:
        """Store (value, result), bucketed and sorted by value."""
        rows = index.select("value", "result").repartition(buckets, "value")
        rows.write.bucketBy(buckets, "value").sortBy("value").option("path", path).saveAsTable(name)
        return cls(index.sparkSession, name, buckets)

    @classmethod
    def open(cls, spark: SparkSession, name: str, path: str, *, schema: str, buckets: int) -> IdIndex:
        spark.sql(
            f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (value) SORTED BY (value) "
            f"INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return cls(spark, name, buckets)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def lookup(self, requests: DataFrame, column: str, name: str = "result") -> DataFrame:
        """Add to every request the id its ``column`` leads to, or NULL.

        The index is read in its buckets, so only the requests are shuffled; a
        request without id has its own match nowhere and is spread by a hash of
        its row.
        """
        kind = self.table().schema["value"].dataType
        spread = F.concat(F.lit("\0"), F.xxhash64(*[c for c, t in requests.dtypes if "map<" not in t]).cast("string"))
        asked = requests.withColumn("_value", F.coalesce(F.col(column).cast(kind), spread.cast(kind)))
        index = self.table().withColumnRenamed("result", "_result").hint("merge")
        joined = asked.join(index, F.col("_value") == F.col("value"), "left")
        found = F.when(F.col(column).isNotNull(), F.col("_result"))
        return joined.select(*requests.columns, found.alias(name))

    def find(self, values: Sequence[str]) -> DataFrame:
        """(value, result) of a few ids; only the buckets that can hold them are read."""
        return self.table().where(F.col("value").isin(list(values)))


@dataclass(frozen=True)
class FetchLog:
    """An append-only log of the papers that were asked for: (paper_id, direction, n_edges, fetched_at).

    Each run of fetches has a directory of its own, which a repeated run replaces.
    """

    spark: SparkSession
    path: str

    def append(self, answers: DataFrame, run: str, fetched_at: str | Column) -> None:
        """Log (paper_id, direction, n_edges) of a run, also papers whose list was empty."""
        at = F.lit(fetched_at).cast("timestamp") if isinstance(fetched_at, str) else fetched_at
        rows = answers.select("paper_id", "direction", "n_edges", at.alias("fetched_at"))
        rows.write.mode("overwrite").parquet(f"{self.path.rstrip('/')}/run={run}")

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def asked(self, direction: str) -> DataFrame:
        """(paper_id) of the papers asked for in a direction, each once."""
        rows = self.read()
        if rows is None:
            return self.spark.createDataFrame([], "paper_id string")
        return rows.where(F.col("direction") == direction).select("paper_id").distinct()
