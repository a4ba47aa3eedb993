"""Line dedup by site-relative frequency.

A line is boilerplate of a host when the share of the host's pages that contain
it is above a ratio; boilerplate lines are dropped from that host's pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_RATIO = 0.05
MIN_PAGES = 5


def _line_key(line: Column) -> Column:
    return F.xxhash64(line)


def boilerplate(
    pages: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies: bool = True,
) -> DataFrame:
    """One row per host that has boilerplate: (host, keys of its boilerplate lines).

    Every row counts as a page, repeated rows too; a line counts once a page.
    Without ``copies``, rows of a host with equal texts (by a 64-bit key) count as
    one page, so that a group of copies does not make its own text boilerplate. A
    NULL host is a host of its own. Lines that are empty or only spaces never
    count. Lines meet by a 64-bit key. Since each boilerplate line is on more
    than ``max_ratio`` of the host's pages, a host has at most (distinct lines of
    its mean page) / ``max_ratio`` of them, however many pages there are.
    """
    given = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    page = F.xxhash64("text").alias("page")
    seen = given if copies else given.select("host", page).distinct()
    totals = seen.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    keys = F.transform(
        F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != ""), _line_key
    )
    lines = given.select("host", page, F.explode_outer(F.array_distinct(keys)).alias("line")).where(
        F.col("line").isNotNull()
    )
    counts = (
        (lines if copies else lines.distinct())
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    per_host = totals.select(F.col("host").alias("t_host"), "total")
    return (
        counts.join(per_host, F.col("host").eqNullSafe(F.col("t_host")))
        .where(F.col("pages") > F.lit(float(max_ratio)) * F.col("total"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def line_dedup(
    pages: DataFrame,
    *,
    host: str = "source",
    text: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies: bool = True,
    spare: bool = False,
) -> DataFrame:
    """``pages`` without their hosts' boilerplate lines.

    All columns come back; ``text`` holds the kept lines, joined by line feeds,
    and ``n_lines`` and ``n_removed`` (long) are added, in place of input columns
    of these names. A NULL text stays NULL with 0 lines; an empty text is one
    empty line. Repeated rows come back as often as they came. ``copies`` is as for
    ``boilerplate``. With ``spare``, a page of which nothing but empty lines would
    be left stays as it is.

    The table of boilerplate lines is small against the pages; Spark broadcasts
    it if its size allows, else the join is by host and splits a hot host.
    """
    lines = staged(
        boilerplate(pages, host=host, text=text, max_ratio=max_ratio, min_pages=min_pages, copies=copies)
    )
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    joined = rows.join(lines, F.col(f"row.{host}").eqNullSafe(F.col("host")), "left")
    all_lines = F.split(F.col(f"row.{text}"), "\n", -1)
    kept = F.filter(
        all_lines,
        lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("lines"), _line_key(x)),
    )
    cut = F.col("lines").isNotNull()
    if spare:
        cut = cut & F.exists(kept, lambda x: F.trim(x) != "")
    marked = joined.select(
        "row",
        F.when(cut, kept).otherwise(all_lines).alias("kept"),
        F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
    )
    plain = [c for c in pages.columns if c not in (text, "n_lines", "n_removed")]
    n_lines = F.when(F.col("n_lines") < 0, F.lit(0)).otherwise(F.col("n_lines"))
    n_kept = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(F.size("kept"))
    return marked.select(
        *[F.col(f"row.`{c}`").alias(c) for c in plain],
        F.array_join("kept", "\n").alias(text),
        n_lines.cast("long").alias("n_lines"),
        (n_lines - n_kept).cast("long").alias("n_removed"),
    )
