"""Connected components by hooking and contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes of ``links`` (a, b): the smallest node reachable.

    In each round every node hooks to its smallest neighbour, chains of hooks are
    shortened, and links are renamed and made distinct; what is left of them
    shrinks at least by half of its nodes. No neighbourhood is gathered, so a node
    with very many links is only an aggregate with a partial sum and a join that
    Spark can split. Tables between rounds are staged; only counts come to the driver.
    """
    edges = staged(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    labels = staged(
        edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node"))
    )
    while not edges.isEmpty():
        hooks = staged(edges.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to")))
        while True:  # shorten chains: from -> to -> further
            on = hooks.select(F.col("from").alias("to"), F.col("to").alias("further"))
            jumped = staged(hooks.join(on, "to", "left"))
            hooks = jumped.select("from", F.coalesce("further", "to").alias("to"))
            if jumped.where(F.col("further").isNotNull()).isEmpty():
                break
        labels = staged(
            labels.join(hooks, F.col("component") == F.col("from"), "left")
            .select("node", F.coalesce("to", "component").alias("component"))
        )
        left = hooks.select(F.col("from").alias("a"), F.col("to").alias("a_to"))
        right = hooks.select(F.col("from").alias("b"), F.col("to").alias("b_to"))
        renamed = (
            edges.join(left, "a", "left").join(right, "b", "left")
            .select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        )
        edges = staged(renamed.distinct())
    return labels
