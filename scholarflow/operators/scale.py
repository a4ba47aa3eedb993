"""Join and numbering helpers that stay balanced when one key is very hot."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from scholarflow.functions.text import sql_text


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    *,
    spread: Sequence[str] | None = None,
    hit: str = "hit",
) -> DataFrame:
    """Left join of ``facts`` to ``dim``, which holds each key at most once.

    The other columns of ``dim`` arrive as one struct column ``hit`` (NULL where
    nothing matched). Every fact row comes back exactly once.

    A hot key makes one large partition of facts against one row of ``dim``, which
    adaptive execution splits by the sizes it sees in the shuffle
    (``spark.sql.adaptive.skewJoin``); the facts are read once. Rows with a NULL
    key need no match and carry a hash of the ``spread`` columns instead of the
    key's, so they go to every task alike. Columns that tell rows apart serve
    best; the default is all that can be hashed.
    """
    keys = list(keys)
    values = [c for c in dim.columns if c not in keys]
    # equal keys must have equal hashes, so both sides get the same types
    typed = [F.col(k).cast(facts.schema[k].dataType).alias(f"_c_{k}") for k in keys]
    found = F.struct(F.lit(True).alias("found"), *values).alias(hit)
    dim = dim.select(*typed, found).withColumn("_c_lead", F.xxhash64(*[f"_c_{k}" for k in keys]))
    spread = list(spread or [c for c, t in facts.dtypes if "map<" not in t and "variant" not in t])
    lead = F.when(_all_set(keys), F.xxhash64(*keys)).otherwise(F.xxhash64(*spread))
    on = _all([F.col("_lead") == F.col("_c_lead")] + [F.col(k) == F.col(f"_c_{k}") for k in keys])
    joined = facts.withColumn("_lead", lead).join(dim, on, "left")
    return joined.select(*facts.columns, hit)


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, path: str | None, *, by: str | None = None) -> DataFrame:
    """``df`` through a written table in a folder on shared storage: it survives
    lost executors and is computed once, however many readers it has. Without a
    path it comes back as it is.

    What was shuffled on the way to the table is removed with the end of the write.
    With ``by`` the table is dealt to buckets by that column, as many as a shuffle
    has partitions: joins and groups by it then move none of its rows.
    """
    if path is None:
        return df
    spark = df.sparkSession
    usual = spark.conf.get(_FREE_SHUFFLES, "false")
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        if by is None:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
            return spark.read.schema(df.schema).parquet(path)
        # only a table of the catalog has buckets; the name goes, the files stay
        name, buckets = f"staged_{uuid.uuid4().hex}", spark.conf.get("spark.sql.shuffle.partitions")
        spark.sql(
            f"CREATE TABLE {name} ({df.schema.toDDL()}) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (`{by}`) INTO {buckets} BUCKETS LOCATION {sql_text(path)}"
        )
        # not saveAsTable, whose write is an execution of its own that keeps its shuffles
        df.write.insertInto(name, overwrite=True)
        out = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
        return out
    finally:
        spark.conf.set(_FREE_SHUFFLES, usual)


def anti_lookup(
    facts: DataFrame,
    present: DataFrame,
    keys: Sequence[str],
    *,
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Fact rows whose key is not in ``present``; duplicates are kept."""
    known = present.select(*keys).distinct()
    joined = lookup_join(facts, known, keys, spread=spread, hit="_known")
    return joined.where(F.col("_known").isNull()).drop("_known")


def number_rows(
    df: DataFrame, *, within: Sequence[str], order: Sequence[str], stage: str, name: str = "row_no"
) -> DataFrame:
    """Number the rows of each group 1, 2, ... in ``order``, also in huge groups.

    Rows are dealt by ranges of (group, order) whose bounds Spark samples, so
    columns of any type serve and a huge group lies in as many tasks as its size asks
    for. The sorted rows are staged in the folder ``stage``, which fixes their
    places; a group's share of a task is a run of places, and the runs are offset
    by the counts of the runs before. NULLs come first. ``order`` must be a total
    order for the numbers to be the same every time.
    """
    by = [F.asc_nulls_first(c) for c in (*within, *order)]
    rows = staged(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), stage
    ).withColumn("_task", F.shiftright("_at", 33))
    runs = rows.groupBy(*within, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*within).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(
        *[F.col(k).alias(f"_o_{k}") for k in within], F.col("_task").alias("_o_task"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"),
    )
    on = [F.col("_task") == F.col("_o_task")] + [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in within]
    return rows.join(offsets, _all(on)).withColumn(name, F.col("_at") + F.col("_offset")).select(*df.columns, name)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _all_set(keys: list[str]) -> Column:
    return _all([F.col(k).isNotNull() for k in keys])
