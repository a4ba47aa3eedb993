"""Per-paper overview tables and review pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarflow.functions import text as X

# --- fixed values -----------------------------------------------------------
REVIEW_SLOTS = ("graphical_abstract", "review", "bibliography")
REVIEW_TEMPLATE = """
-------

<!-- graphical abstract -->

$(graphical_abstract)

<!-- graphical abstract -->

-------

<!-- review -->

$(review)

<!-- review -->

-------

<!-- bibliography -->

$(bibliography)

<!-- bibliography -->

-------
"""
# ----------------------------------------------------------------------------


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def overview(docs: DataFrame, *, key: str = "key", only: str | None = None) -> DataFrame:
    """(key, Overview): title, citation count as superscript, subtitle, summary."""
    shown = docs if only is None else docs.where(F.col(key) == only)
    return shown.select(
        key,
        F.concat(
            _text("title"), F.lit("<sup>"), _text("total_citation"), F.lit("</sup><br>"),
            _text("subtitle"), F.lit("<br><br>"), _text("tldr"),
        ).alias("Overview"),
    )


def links_view(
    docs: DataFrame, *, reader_root: str, slide_root: str, key: str = "key",
    only: str | None = None,
) -> DataFrame:
    """(key, title, KR, EN, Link, Slide): links to a paper's renderings.

    The path of the original loses its outer slashes and has '-' for the inner
    ones.
    """
    shown = docs if only is None else docs.where(F.col(key) == only)
    inner = F.regexp_replace(_text("original"), r"^/|/\z", "")
    path = F.concat(F.lit(reader_root), F.replace(inner, F.lit("/"), F.lit("-")))

    def wiki(suffix: str, label: str) -> Column:
        return F.concat(F.lit("[["), path, F.lit(f"/{suffix}|{label}]]"))

    return shown.select(
        key,
        "title",
        wiki("zh", "kr").alias("KR"),
        wiki("en", "en").alias("EN"),
        F.concat(F.lit(f"[doi.org]({X.DOI_PREFIX}"), _text("doi"), F.lit(")")).alias("Link"),
        F.concat(F.lit(f"[slide]({slide_root}"), _text(key), F.lit(".md)")).alias("Slide"),
    )


def review_page(docs: DataFrame, *, key: str = "key", template: str = REVIEW_TEMPLATE) -> DataFrame:
    """(key, page): the template with its $(slot) marks filled; NULL gives ''.

    The template is cut at the marks first, so a value that holds a mark itself
    is left as it is.
    """
    parts: list[Column] = []
    rest = template
    while True:
        hits = [(rest.find(f"$({s})"), s) for s in REVIEW_SLOTS if f"$({s})" in rest]
        if not hits:
            break
        at, slot = min(hits)
        parts += [F.lit(rest[:at]), _text(slot)]
        rest = rest[at + len(slot) + 3:]
    return docs.select(key, F.concat(*parts, F.lit(rest)).alias("page"))
