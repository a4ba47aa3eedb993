"""The paper table: normalising API answers, missing sets, upserts, venues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarflow.functions import text as X
from scholarflow.operators.scale import anti_lookup, lookup_join, number_rows, staged

# --- fixed values -----------------------------------------------------------
PAYLOAD_SCHEMA = (
    "title STRING, authors ARRAY<STRUCT<name: STRING>>, year INT, venue STRING, "
    "abstract STRING, citationCount BIGINT, externalIds MAP<STRING, STRING>, "
    "publicationDate STRING"
)
CORRUPT = "_corrupt"  # where an unreadable payload is put
PAPER_COLUMNS = (
    "semantic_id", "title", "date", "authors", "year", "venue", "venue_short",
    "abstract", "citation_count", "external_ids",
)
DISPLAY_DEFAULTS = {
    "title": "Unknown Title",
    "date": "Unknown Date",
    "year": "Unknown Year",
    "venue": "Unknown Venue",
    "venue_short": "Unknown Venue",
    "abstract": "No abstract available.",
    "citation_count": "Unknown",
}
OWN_KEYS = ("SEMANTIC", "IEEE", "ACM")
# ----------------------------------------------------------------------------


def clean_ids(lines: DataFrame, column: str = "value", name: str = "id") -> DataFrame:
    """Id list from text lines: stripped, blank lines dropped, duplicates kept."""
    return lines.select(X.strip(column).alias(name)).where(F.col(name) != "")


def external_ids(semantic_id: Column, given: Column, source: Column, document: Column) -> Column:
    """The id map: own id, then IEEE and ACM as told by the resolved DOI."""
    kept = F.map_filter(
        F.coalesce(given, F.expr("cast(map() as map<string,string>)")),
        lambda k, v: ~k.isin(*OWN_KEYS),
    )
    own = F.create_map(
        F.lit("SEMANTIC"), semantic_id,
        F.lit("IEEE"), F.when(source == "IEEE", document),
        F.lit("ACM"), F.when(source == "ACM", document),
    )
    return F.map_concat(kept, own)


def override_ids(papers: DataFrame, **overrides: Column) -> DataFrame:
    """Set ids of the given namespaces where the override is neither NULL nor ''."""
    given = F.map_filter(
        F.create_map(*[c for k, v in overrides.items() for c in (F.lit(k), X.blank_to_null(v))]),
        lambda k, v: v.isNotNull(),
    )
    kept = F.map_filter("external_ids", lambda k, v: ~F.map_contains_key(given, k))
    return papers.withColumn("external_ids", F.map_concat(kept, given))


def parsed_payloads(raw: DataFrame) -> DataFrame:
    """(paper_id, payload, p, readable): answers that hold anything, parsed.

    An answer that is no JSON object is not readable; one with a field of an
    unexpected type is, without that field.
    """
    filled = ~F.col("payload").rlike(r"^\s*(\{\s*\}|null)?\s*$")
    schema = f"{PAYLOAD_SCHEMA}, {CORRUPT} STRING"
    p = F.from_json("payload", schema, {"columnNameOfCorruptRecord": CORRUPT})
    rows = raw.where(filled).select("paper_id", "payload", p.alias("p"))
    fields = [F.col(f"p.{f.name}").isNotNull() for f in rows.schema["p"].dataType if f.name != CORRUPT]
    some = fields[0]
    for f in fields[1:]:
        some = some | f
    return rows.withColumn("readable", some | F.col(f"p.{CORRUPT}").isNull())


def unreadable_answers(raw: DataFrame) -> DataFrame:
    """(paper_id, payload) of the answers that ``normalise_papers`` leaves out as unreadable."""
    return parsed_payloads(raw).where(~F.col("readable")).select("paper_id", "payload")


def normalise_papers(
    raw: DataFrame, doi_resolved: DataFrame, journals: DataFrame, *, stage: str | None = None
) -> DataFrame:
    """API answers (paper_id, payload JSON) to paper rows.

    Answers without any field are dropped, and so are unreadable ones (see
    ``unreadable_answers``). A date that is none becomes NULL. ``doi_resolved`` is (doi, url). With
    ``stage``, a folder on shared storage, the parsed answers are written there,
    so that the payloads are read once and later passes read single columns.
    """
    from scholarflow.operators.ids import resolve_doi

    parsed = (
        parsed_payloads(raw).where("readable")
        .select(
            F.col("paper_id").alias("semantic_id"),
            F.col("p.title").alias("title"),
            F.col("p.publicationDate").try_cast("date").alias("date"),
            F.transform("p.authors", lambda a: a["name"]).alias("authors"),
            F.col("p.year").alias("year"),
            F.col("p.venue").alias("venue"),
            X.clean_abstract("p.abstract").alias("abstract"),
            F.col("p.citationCount").alias("citation_count"),
            F.col("p.externalIds").alias("given_ids"),
            F.col("p.externalIds")["DOI"].alias("doi"),
        )
    )
    parsed = staged(parsed, stage and f"{stage}/parsed")
    named = with_venue_short(parsed, journals, spread=["semantic_id"])
    named = resolve_doi(named, doi_resolved, spread=["semantic_id"])
    ids = external_ids(
        F.col("semantic_id"), F.col("given_ids"), F.col("source"), F.col("document_id")
    )
    return named.withColumn("external_ids", ids).select(*PAPER_COLUMNS)


def papers_display(papers: DataFrame) -> DataFrame:
    """Paper rows as text, with the display default in place of each NULL."""
    shown = [
        F.coalesce(F.col(c).cast("string"), F.lit(DISPLAY_DEFAULTS[c])).alias(c)
        if c in DISPLAY_DEFAULTS
        else F.coalesce(c, F.expr("cast(array() as array<string>)")).alias(c)
        if c == "authors"
        else F.col(c)
        for c in papers.columns
    ]
    return papers.select(*shown)


def first_journals(journals: DataFrame) -> DataFrame:
    """(journal, name_short, ordinal) with each name once.

    A repeated name keeps its first position and takes its last short name.
    """
    return journals.groupBy("journal").agg(
        F.max_by("name_short", "ordinal").alias("name_short"),
        F.min("ordinal").alias("ordinal"),
    )


# characters of the grams that journal names are found by
GRAM = 4


def venue_names(venues: DataFrame, journals: DataFrame) -> DataFrame:
    """(venue, venue_short) for distinct venues.

    The first journal in list order whose name occurs in the venue, ignoring
    case, gives the short name. Each name is filed under its gram of ``GRAM``
    characters that the fewest names have (a shorter name under itself). A venue is
    expanded to its grams, as many rows as it has characters, once for
    each length of at most ``GRAM``, however long and many the names are; where
    a name is filed under a gram, the whole name is compared in place.
    """
    names = first_journals(journals).select(
        F.lower("journal").alias("_name"), "name_short", "ordinal"
    ).where(F.col("_name").isNotNull())
    names = names.groupBy("_name").agg(
        F.min_by("name_short", "ordinal").alias("name_short"), F.min("ordinal").alias("ordinal")
    )
    width = F.least(F.length("_name"), F.lit(GRAM))
    grams = names.select("*", width.alias("_len"), F.explode(
        F.sequence(F.lit(0), F.length("_name") - width)
    ).alias("_off")).withColumn("_gram", F.substr("_name", F.col("_off") + 1, F.col("_len")))
    often = grams.groupBy("_gram").agg(F.count_distinct("_name").alias("_often"))
    filed = grams.join(often, "_gram").groupBy("_name").agg(
        F.min_by(F.struct("_gram", "_off", "name_short", "ordinal"), F.struct("_often", "_gram", "_off")).alias("_f")
    ).select("_name", "_f.*")
    lengths = names.agg(F.collect_set(width).alias("lengths")).scalar()
    size = F.length("_low")
    spots = (
        venues.select("venue", F.lower("venue").alias("_low"), F.explode(lengths).alias("_len"))
        .where(F.col("_len") <= size)
        .select("venue", "_low", "_len", F.explode(F.sequence(F.lit(0), size - F.col("_len"))).alias("_pos"))
        .select("venue", "_low", "_pos", F.substr("_low", F.col("_pos") + 1, F.col("_len")).alias("_gram"))
    )
    start = F.col("_pos") - F.col("_off")
    return (
        spots.join(filed, "_gram")
        .where((start >= 0) & (F.substr("_low", start + 1, F.length("_name")) == F.col("_name")))
        .groupBy("venue")
        .agg(F.min_by("name_short", "ordinal").alias("venue_short"))
    )


def with_venue_short(
    papers: DataFrame, journals: DataFrame, *, spread: list[str] | None = None
) -> DataFrame:
    """Add ``venue_short``; NULL where no journal name occurs in the venue."""
    venues = papers.where(F.col("venue").isNotNull()).select("venue").distinct()
    named = venue_names(venues, journals)
    joined = lookup_join(papers, named, ["venue"], spread=spread, hit="_v")
    return joined.withColumn("venue_short", F.col("_v.venue_short")).drop("_v")


def papers_with_id(papers: DataFrame, key: str = "IEEE") -> DataFrame:
    return papers.where(F.col("external_ids")[key].isNotNull())


def new_ids(
    ids: DataFrame, papers: DataFrame, *, column: str = "id", key: str = "semantic_id",
    mode: str = "missing",
) -> DataFrame:
    """Listed ids that are not stored yet, each once; with mode ``all`` the
    list as it is."""
    if _mode(mode) == "all":
        return ids.select(column)
    stored = papers.select(F.col(key).alias(column))
    return ids.select(column).distinct().join(stored, column, "left_anti")


def _mode(mode: str) -> str:
    if mode not in ("missing", "all"):
        raise ValueError(f"mode must be 'missing' or 'all', not {mode!r}")
    return mode


def papers_to_fetch(
    papers: DataFrame,
    fetched: DataFrame,
    *,
    mode: str = "missing",
    key: str = "paper_id",
    spread: list[str] | None = None,
) -> DataFrame:
    """Papers whose edges are to be fetched: all, or those not in ``fetched``.

    Duplicates are kept. ``fetched`` is the log of asked papers, so a paper
    with no edges counts as fetched.
    """
    if _mode(mode) == "all":
        return papers
    return anti_lookup(papers, fetched, [key], spread=spread)


def pending_downloads(papers: DataFrame, downloaded: DataFrame, key: str = "IEEE") -> DataFrame:
    """(semantic_id, document_id) of papers with an id in ``key`` and no page yet."""
    return (
        papers_with_id(papers, key)
        .select("semantic_id", F.col("external_ids")[key].alias("document_id"))
        .join(downloaded.select("semantic_id"), "semantic_id", "left_anti")
    )


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of each key.

    An aggregate, not a window: partial results combine before the shuffle, so
    a key with very many versions costs no single task.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def upsert(
    old: DataFrame, new: DataFrame, keys: list[str], *, written: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key.

    Of several rows of ``new`` with one key the last stays, by the columns
    ``written`` (a time or a number of the write); without them, keys must be
    unique in ``new``.
    """
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    return latest_by(both, keys, ["_gen", *written]).drop("_gen")


def id_batches(
    df: DataFrame, *, within: list[str], order: list[str], size: int, stage: str
) -> DataFrame:
    """Add ``batch_no`` (from 0): consecutive rows of a group in batches of ``size``.

    Columns of any type; one group may hold most rows. ``stage`` is a folder on
    shared storage for the sorted rows.
    """
    numbered = number_rows(df, within=within, order=order, stage=stage, name="_no")
    return numbered.withColumn("batch_no", F.expr(f"(_no - 1) div {int(size)}")).drop("_no")
