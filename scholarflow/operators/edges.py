"""Citation and reference edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
_PAPER = "paperId: STRING, title: STRING, year: INT, venue: STRING"
PAYLOAD_SCHEMA = (
    "data ARRAY<STRUCT<" + _PAPER + ", intents: ARRAY<STRING>, isInfluential: BOOLEAN, "
    "citingPaper: STRUCT<" + _PAPER + ">, citedPaper: STRUCT<" + _PAPER + ">>>"
)
# ----------------------------------------------------------------------------


def _listed() -> Column:
    """The edges of a payload: listed under ``data``, or the payload itself."""
    bare = F.startswith(F.ltrim("payload"), F.lit("["))
    text = F.when(bare, F.concat(F.lit('{"data":'), "payload", F.lit("}"))).otherwise(F.col("payload"))
    return F.from_json(text, PAYLOAD_SCHEMA)["data"]


def asked_papers(raw: DataFrame) -> DataFrame:
    """(paper_id, direction, n_edges) of every answer, also of those without any edge."""
    return raw.select("paper_id", "direction", F.coalesce(F.size(_listed()), F.lit(0)).alias("n_edges"))


def flatten_edges(raw: DataFrame) -> DataFrame:
    """Edge rows from (paper_id, direction, payload JSON).

    The payload lists edges under ``data``, with the other paper's fields
    nested or flat, or is that list itself, as edge files hold it. A paper with
    an empty or absent list gives no row. ``ordinal`` is the place in the list.
    """
    listed = raw.select("paper_id", "direction", F.posexplode(_listed()).alias("ordinal", "e"))

    def field(name: str):
        nested = F.when(
            F.col("direction") == "citation", F.col(f"e.citingPaper.{name}")
        ).otherwise(F.col(f"e.citedPaper.{name}"))
        return F.coalesce(nested, F.col(f"e.{name}"))

    return listed.select(
        "paper_id",
        "direction",
        field("paperId").alias("other_id"),
        field("title").alias("title"),
        field("year").alias("year"),
        field("venue").alias("venue"),
        F.col("e.intents").alias("intents"),
        F.col("e.isInfluential").alias("is_influential"),
        "ordinal",
    )


def bibliography(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Both edge kinds in one table, told apart by ``direction``."""
    return citations.withColumn("direction", F.lit("citation")).unionByName(
        references.withColumn("direction", F.lit("reference")), allowMissingColumns=True
    )


def frontier(
    edges: DataFrame, papers: DataFrame, k: int, *, paper_id: str | None = None
) -> DataFrame:
    """The ``k`` most linked papers that are not stored yet.

    Ranked by edge count, then influential edges, then id; ``paper_id`` limits
    the edges to one paper. Edges collapse to one row per target on the map
    side, before the anti join, so a target that everybody links is no hot key.
    """
    if paper_id is not None:
        edges = edges.where(F.col("paper_id") == paper_id)
    counted = edges.where(F.col("other_id").isNotNull()).groupBy("other_id").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.count_if("is_influential").alias("n_influential"),
    )
    stored = papers.select(F.col("semantic_id").alias("other_id"))
    return (
        counted.join(stored, "other_id", "left_anti")
        .orderBy(F.desc("n_edges"), F.desc("n_influential"), "other_id")
        .limit(k)
    )
