"""One registered query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarflow.functions import text as X
from scholarflow.operators import chunks as C
from scholarflow.operators import edges as E
from scholarflow.operators import ids as I
from scholarflow.operators import pages as P
from scholarflow.operators import papers as A
from scholarflow.operators import views as V
from scholarflow.plans import corpus, inputs
from scholarflow.plans.inputs import documents, lines, table, text_of
from scholarflow.sources import sinks as K
from scholarflow.sources.stores import BucketStore, FetchLog, IdIndex
from scholarflow.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CHUNK_TOKENS = 200
PART_TOKENS = 60


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- scalars ------------------------------------------------------------------


@query
def strip_unicode(spark, sf):
    padded = F.concat(F.lit("　\x1f "), "text", F.lit(" \t\n"))
    return documents(spark, sf, "text").select("doc_id", X.strip(padded).alias("stripped"))


@query
def clean_abstract(spark, sf):
    text = F.replace("text", F.lit(". "), F.lit(" $\\beta\t $ "))
    return documents(spark, sf, "text").select("doc_id", X.clean_abstract(text).alias("abstract"))


@query
def heading_slug(spark, sf):
    return documents(spark, sf, "text").select("doc_id", X.heading_slug("text").alias("slug"))


@query
def escape_citation(spark, sf):
    mark = F.when(
        F.col("lang") == "en", F.concat(F.lit("["), "source", F.lit("]"))
    ).otherwise(F.concat("source", F.lit("[]")))
    return documents(spark, sf, "lang", "source").select(
        "doc_id", X.escape_citation(mark).alias("mark")
    )


@query
def drop_extension(spark, sf):
    name = F.concat("source", F.lit("."), "lang", F.lit(".v"), "doc_id", F.lit(".md"))
    return documents(spark, sf, "lang", "source").select(
        "doc_id", X.drop_extension(name).alias("stem"),
        X.drop_extension(F.concat(F.lit("."), "source")).alias("hidden"),
    )


@query
def contains_ignore_case(spark, sf):
    return documents(spark, sf, "lang", "text").select(
        "doc_id", X.contains_ignore_case("text", F.lit("THE ")).alias("article"),
        X.contains_ignore_case("text", F.concat("lang", F.lit("e"))).alias("by_lang"),
    )


@query
def front_matter(spark, sf):
    docs = inputs.markdown_docs(spark, sf).select("doc_id", X.front_matter("markdown").alias("s"))
    return docs.select("doc_id", "s.header", "s.body")


@query
def unescape_text(spark, sf):
    pages = inputs.web_pages(spark, sf)
    return pages.select("page_id", X.unescape_html("html").alias("html"))


# --- papers -------------------------------------------------------------------


@query
def normalise_papers(spark, sf):
    papers = A.normalise_papers(
        inputs.raw_papers(spark, sf), inputs.resolved_dois(spark, sf), inputs.journals(spark)
    )
    ids = F.col("external_ids")
    return papers.select(
        "semantic_id", "title", F.col("date").cast("string").alias("date"),
        F.array_join("authors", ";").alias("authors"), "year", "venue", "venue_short",
        "abstract", "citation_count",
        *[ids[k].alias(f"id_{k.lower()}") for k in ("SEMANTIC", "IEEE", "ACM", "DOI", "CorpusId")],
    )


@query
def papers_display(spark, sf):
    papers = A.normalise_papers(
        inputs.raw_papers(spark, sf), inputs.resolved_dois(spark, sf), inputs.journals(spark)
    )
    shown = A.papers_display(papers.withColumn("year", F.nullif("year", F.lit(1901))))
    return shown.select(
        "semantic_id", "title", "date", "year", "venue", "venue_short", "abstract", "citation_count"
    )


@query
def override_ids(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "lang", "source")
    papers = docs.select(
        "doc_id",
        F.create_map(
            F.lit("SEMANTIC"), text_of("doc_id"), F.lit("IEEE"), F.col("source"),
            F.lit("ACM"), F.lit(None).cast("string"),
        ).alias("external_ids"),
        F.when(F.col("lang") == "en", "").when(F.col("lang") == "fr", F.col("source")).alias("acm"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("ieee"),
    )
    out = A.override_ids(papers, IEEE=F.col("ieee"), ACM=F.col("acm"))
    ids = F.col("external_ids")
    return out.select("doc_id", ids["SEMANTIC"].alias("semantic"), ids["IEEE"].alias("ieee_id"), ids["ACM"].alias("acm_id"))


@query
def venue_short(spark, sf):
    return A.with_venue_short(
        inputs.part_venues(spark, sf), inputs.journals(spark), spread=["p_partkey"]
    )


@query
def missing_ids(spark, sf):
    lines = table(spark, sf, "documents", "doc_id").select(
        F.concat(F.lit("  "), "doc_id", F.lit("\t")).alias("value")
    )
    stored = table(spark, sf, "labels", "doc_id").select(text_of("doc_id").alias("semantic_id"))
    return A.new_ids(A.clean_ids(lines), stored)


@query
def missing_edges_bag(spark, sf):
    papers = table(spark, sf, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "paper_id")
    fetched = table(spark, sf, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "paper_id")
    return A.papers_to_fetch(papers, fetched, mode="missing", spread=["paper_id"])


@query
def all_edges_bag(spark, sf):
    papers = table(spark, sf, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_orderkey", "paper_id")
    return A.papers_to_fetch(papers, papers, mode="all")


@query
def pending_download(spark, sf):
    downloaded = table(spark, sf, "labels", "doc_id").select(text_of("doc_id").alias("semantic_id"))
    return A.pending_downloads(inputs.url_papers(spark, sf), downloaded, "ORG")


@query
def latest_wins(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_id", "ts", "event_type")
    return A.latest_by(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query
def papers_upsert(spark, sf):
    old = table(spark, sf, "documents", "doc_id", "source").withColumnRenamed("source", "value")
    new = table(spark, sf, "labels", "doc_id", "quality").select(
        "doc_id", F.concat(F.lit("q"), "quality").alias("value")
    )
    return A.upsert(old, new, ["doc_id"])


def _folder(spark, name: str) -> str:
    return f"{ingest.work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def bucket_upsert(spark, sf):
    """The upsert through a table in hash buckets, which each write rewrites in part."""
    folder = _folder(spark, "papers")
    store = BucketStore(spark, f"{folder}/table", ("doc_id",), 16)
    old = table(spark, sf, "documents", "doc_id", "source").withColumnRenamed("source", "value")
    new = table(spark, sf, "labels", "doc_id", "quality").select(
        "doc_id", F.concat(F.lit("q"), "quality").alias("value")
    )
    store.upsert(old, stage=f"{folder}/first")
    store.upsert(new, stage=f"{folder}/second")
    return store.read().select("doc_id", "value")


@query
def id_batches(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_id")
    return A.id_batches(
        events, within=["user_id"], order=["event_id"], size=25, stage=f"{_folder(spark, 'batches')}/sorted"
    )


@query
def run_counts(spark, sf):
    """Sizes of a run: documents listed and new, chapters, parts, tokens."""
    docs = inputs.markdown_docs(spark, sf)
    plan = C.chunk_plan(C.chapter_rows(docs), threshold=PART_TOKENS)
    body = plan.where(F.col("chapter_no") != C.HEADER_NO)
    sizes = body.agg(
        F.count(F.lit(1)).alias("chapters"),
        F.sum("n_parts").alias("parts"),
        F.sum("n_tokens").alias("tokens"),
        F.sum(F.length("text")).alias("characters"),
    )
    new = A.new_ids(
        table(spark, sf, "documents", "doc_id"), table(spark, sf, "labels", "doc_id"),
        column="doc_id", key="doc_id",
    ).agg(F.count(F.lit(1)).alias("to_fetch"))
    names = ("chapters", "parts", "tokens", "characters")
    long = sizes.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("n")) for n in names
    ])))
    return long.unionByName(new.select(F.lit("to_fetch").alias("metric"), F.col("to_fetch").alias("n")))


# --- ids ----------------------------------------------------------------------


@query
def classify_url(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "url")
    found = X.classify_url(inputs.publisher_url())
    return pages.select("page_id", found.alias("f")).select("page_id", "f.source", "f.document_id")


@query
def doi_source(spark, sf):
    docs = table(spark, sf, "documents", "doc_id").withColumn("doi", F.concat(F.lit("10.5555/p"), "doc_id"))
    return I.resolve_doi(docs, inputs.resolved_dois(spark, sf), spread=["doc_id"])


@query
def id_rows(spark, sf):
    return I.ext_ids(inputs.url_papers(spark, sf))


@query
def papers_with_id(spark, sf):
    return A.papers_with_id(inputs.url_papers(spark, sf), "ORG").select("semantic_id")


@query
def lookup_id(spark, sf):
    papers = inputs.url_papers(spark, sf)
    asked = table(spark, sf, "documents", "doc_id").withColumn("value", text_of("doc_id"))
    found = I.lookup_ids(asked, papers, "IEEE", "SEMANTIC", name="semantic_id", spread=["doc_id"])
    return I.lookup_ids(found, papers, "IEEE", "ORG", name="org", spread=["doc_id"])


@query
def semantic_to_ieee(spark, sf):
    asked = table(spark, sf, "events", "event_id", "user_id").select(
        "event_id", F.concat(F.lit("S"), "user_id").alias("semantic_id")
    )
    return I.semantic_to_ieee(asked, inputs.numbered_papers(spark, sf), spread=["event_id"])


@query
def stored_lookup(spark, sf):
    """Own id to publisher id through a stored index, whose side is not shuffled."""
    asked = table(spark, sf, "events", "event_id", "user_id").select(
        "event_id", F.concat(F.lit("S"), "user_id").alias("semantic_id")
    )
    pairs = I.id_index(inputs.numbered_papers(spark, sf), "SEMANTIC", "IEEE")
    name = f"ids_{uuid.uuid4().hex}"
    return IdIndex.write(pairs, name, _folder(spark, "ids"), buckets=8).lookup(asked, "semantic_id", "ieee_id")


def _doi_requests(spark, sf):
    return table(spark, sf, "events", "event_id", "props").select(
        "event_id", F.concat(F.lit("10.5555/d"), F.get_json_object("props", "$.k")).alias("doi")
    )


@query
def resolve_cascade(spark, sf):
    return I.semantic_from_doi(
        _doi_requests(spark, sf), inputs.numbered_papers(spark, sf),
        inputs.numbered_answers(spark, sf), spread=["event_id"],
    )


@query
def fetched_new_papers(spark, sf):
    """Papers that only a landed answer knows: what the cascade has to store."""
    found = resolve_cascade(spark, sf)
    return found.where("is_new").select("semantic_id", "doi").distinct()


@query
def resolve_ieee(spark, sf):
    asked = table(spark, sf, "events", "event_id", "user_id").select(
        "event_id", text_of("user_id").alias("ieee_id")
    )
    doi = F.when(F.col("lang") != "fr", F.concat(F.lit("10.5555/d"), "doc_id"))
    dois = table(spark, sf, "documents", "doc_id", "lang").select(
        text_of("doc_id").alias("ieee_id"), doi.alias("doi")
    )
    index = I.semantic_index_of_ieee(
        inputs.numbered_papers(spark, sf), dois, inputs.numbered_answers(spark, sf)
    )
    return I.semantic_from_ieee(asked, index, spread=["event_id"])


@query
def doi_on_page(spark, sf):
    block = inputs.fill(
        '<div>{{text}}</div><div class="u-pb-1 stats-document-abstract-doi"><strong>DOI:</strong>'
        '<a href="https://doi.org/10.5555/p{{doc}}"> 10.5555/p{{doc}}</a></div>',
        text=X.escape_html("text"), doc=F.col("doc_id"),
    )
    pages = documents(spark, sf, "text").select(
        F.col("doc_id").alias("document_id"), block.alias("html")
    )
    return P.doi_on_page(pages)


# --- edges --------------------------------------------------------------------


@query
def edges_flat(spark, sf):
    edges = E.flatten_edges(inputs.raw_edges(spark, sf))
    return edges.withColumn("intents", F.array_join("intents", ","))


@query
def citations_flat(spark, sf):
    """The other direction, with nested, flat and bare payloads."""
    edges = E.flatten_edges(inputs.raw_citations(spark, sf))
    return edges.withColumn("intents", F.array_join("intents", ","))


@query
def edges_written(spark, sf):
    """Edges through their table, which has a directory per direction."""
    path = f"{ingest.work_dir(spark)}/edges-{uuid.uuid4().hex}"
    K.write_edges(edges_flat(spark, sf), path)
    return spark.read.parquet(path)


@query
def fetch_log(spark, sf):
    """The labelled papers are asked first; what is logged of them, and who is still to be asked."""
    folder = _folder(spark, "fetched")
    log = FetchLog(spark, f"{folder}/log")
    labelled = table(spark, sf, "labels", "doc_id").select(text_of("doc_id").alias("paper_id"))
    raw = inputs.raw_edges(spark, sf).join(labelled, "paper_id", "left_semi")
    K.write_fetched(raw, f"{folder}/edges", log, run="1", fetched_at="2024-01-01")
    papers = table(spark, sf, "documents", "doc_id").select(text_of("doc_id").alias("paper_id"))
    due = A.papers_to_fetch(papers, log.asked("reference"), spread=["paper_id"])
    return log.read().select("paper_id", "n_edges").unionByName(due, allowMissingColumns=True)


@query
def bibliography(spark, sf):
    cited = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity").select(
        text_of("l_orderkey").alias("paper_id"), text_of("l_partkey").alias("other_id"),
        (F.col("l_quantity") > 25).alias("is_influential"),
    )
    refs = table(spark, sf, "orders", "o_orderkey", "o_custkey").select(
        text_of("o_orderkey").alias("paper_id"), text_of("o_custkey").alias("other_id")
    )
    return E.bibliography(cited, refs)


@query
def frontier_topk(spark, sf):
    edges = table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity").select(
        F.col("l_orderkey").alias("paper_id"), text_of("l_partkey").alias("other_id"),
        (F.col("l_quantity") > 25).alias("is_influential"),
    )
    stored = table(spark, sf, "part", "p_partkey", "p_size").where(F.col("p_size") > 25).select(
        text_of("p_partkey").alias("semantic_id")
    )
    return E.frontier(edges, stored, 50)


# --- pages --------------------------------------------------------------------


@query
def html_tokens(spark, sf):
    return P.page_tokens(inputs.web_pages(spark, sf))


@query
def html_headings(spark, sf):
    return P.section_outline(inputs.web_pages(spark, sf), inputs.WEB_PAGE)


@query
def html_sections(spark, sf):
    return P.sections(inputs.web_pages(spark, sf), inputs.WEB_PAGE)


@query
def html_markdown(spark, sf):
    return P.page_markdown(inputs.web_pages(spark, sf), inputs.WEB_PAGE)


@query
def html_links(spark, sf):
    maps = P.link_maps(P.page_links(inputs.web_pages(spark, sf)), ["page_id"])
    return maps.select("page_id", F.explode("links").alias("text", "href"))


@query
def html_unhandled(spark, sf):
    return P.unhandled(inputs.web_pages(spark, sf), inputs.WEB_PAGE)


@query
def page_sections(spark, sf):
    return P.sections(inputs.publisher_pages(spark, sf))


@query
def html_lists(spark, sf):
    """The list lines of all sections."""
    items = F.filter(F.split("content", "\n", -1), lambda x: F.startswith(x, F.lit("- ")))
    return P.sections(inputs.publisher_pages(spark, sf)).select(
        "page_id", "ordinal", F.posexplode(items).alias("item_no", "item")
    )


@query
def rich_sections(spark, sf):
    """Numbered lists, display formulas, every kind of link, a figure that cannot be parsed."""
    return P.sections(inputs.rich_pages(spark, sf))


@query
def rich_xrefs(spark, sf):
    pages = inputs.rich_pages(spark, sf)
    return P.resolve_xrefs(P.xrefs(pages), P.link_targets(pages))


@query
def html_figures(spark, sf):
    return P.figures(inputs.publisher_pages(spark, sf))


@query
def image_manifest(spark, sf):
    directory = F.concat(F.lit("img/"), F.col("page_id"), F.lit("_img"))
    return P.image_manifest(P.figures(inputs.publisher_pages(spark, sf)), directory)


@query
def xref_resolve(spark, sf):
    pages = inputs.publisher_pages(spark, sf)
    return P.resolve_xrefs(P.xrefs(pages), P.link_targets(pages))


@query
def page_markdown(spark, sf):
    return P.page_markdown(inputs.publisher_pages(spark, sf))


def _link_text(links: Column) -> Column:
    pairs = F.array_sort(F.map_entries(links))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


@query
def reference_list(spark, sf):
    papers, answers = inputs.labelled_papers(spark, sf), inputs.language_answers(spark, sf)
    rows = P.references(
        inputs.reference_pages(spark, sf),
        I.semantic_index_of_doi(papers, answers),
        I.semantic_index_of_ieee(papers, inputs.page_dois(spark, sf), answers),
    )
    return rows.withColumn("links", _link_text(F.col("links")))


def _corpus(spark, sf) -> corpus.Corpus:
    pages = inputs.publisher_pages(spark, sf).drop("semantic_id")
    dois = table(spark, sf, "documents", "doc_id").select(
        text_of("doc_id").alias("ieee_id"), F.concat(F.lit("10.5555/d"), "doc_id").alias("doi")
    )
    return corpus.build_corpus(
        pages, inputs.reference_pages(spark, sf), inputs.numbered_papers(spark, sf), dois,
        inputs.numbered_answers(spark, sf), stage=f"{ingest.work_dir(spark)}/corpus-{uuid.uuid4().hex}",
    )


@query
def corpus_summary(spark, sf):
    """What the whole job makes of each page whose id can be resolved."""
    built = _corpus(spark, sf)

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias(name))

    return (
        built.pages.select("page_id", "semantic_id")
        .join(counted(built.sections, "n_sections"), "page_id")
        .join(counted(built.figures, "n_figures"), "page_id")
        .join(counted(built.references, "n_references"), "page_id")
        .join(built.markdown.select(
            "page_id", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("markdown_md5")
        ), "page_id")
    )


@query
def crawl_records(spark, sf):
    """The nested record of each page, read back from its JSON."""
    records = _corpus(spark, sf).records(output_dir="out", image_dir="img", info_dir="info")
    field = lambda p: F.get_json_object("record", p)
    parsed = F.from_json("record", (
        "reference_info array<struct<number string,title string,semantic string>>, img_info array<struct<img_file_name string>>, "
        "section_info array<struct<level int,title string,content string,section_id string>>"
    ))

    def listed(name: str, *fields: str) -> Column:
        """All elements, one per line, with their fields."""
        shown = lambda x: F.concat_ws("|", *[F.coalesce(x[f].cast("string"), F.lit("-")) for f in fields])
        return F.array_join(F.transform(F.col("parsed")[name], shown), "\n").alias(name)

    return records.withColumn("parsed", parsed).select(
        "page_id",
        field("$.ieee_paper_id").alias("ieee_paper_id"),
        field("$.semantic_id").alias("semantic_id"),
        field("$.output_md_path").alias("output_md_path"),
        field("$.final_img_dir").alias("final_img_dir"),
        field("$.paper_info_path").alias("paper_info_path"),
        listed("reference_info", "number", "semantic", "title"),
        listed("img_info", "img_file_name"),
        listed("section_info", "level", "section_id", "title", "content"),
    )


# --- chunks and transforms ------------------------------------------------------


@query
def chapters(spark, sf):
    rows = C.chapter_rows(inputs.markdown_docs(spark, sf))
    return rows.where(F.col("chapter_no") != C.HEADER_NO)


def _whole_texts(spark, sf):
    return documents(spark, sf, "text")


@query
def chunk_plan(spark, sf):
    plan = C.chunk_plan(_whole_texts(spark, sf), threshold=CHUNK_TOKENS)
    return plan.select("doc_id", "n_tokens", "n_parts")


@query
def chunks(spark, sf):
    return C.chunk_rows(_whole_texts(spark, sf), threshold=CHUNK_TOKENS, delimiter="\n")


@query
def chunks_by_pattern(spark, sf):
    return C.chunk_rows(_whole_texts(spark, sf), threshold=CHUNK_TOKENS, pattern=r"\. ")


@query
def transform_roundtrip(spark, sf):
    """Flagship: Markdown to chapters to parts, transformed and put together."""
    return C.transform_in_place(
        inputs.markdown_docs(spark, sf), F.lower, threshold=PART_TOKENS, delimiter=". "
    )


@query
def transform_callable(spark, sf):
    """The flagship with a Python callable in the place of the expression."""
    return corpus.transform_markdown(
        inputs.markdown_docs(spark, sf), lambda: str.lower, threshold=PART_TOKENS, delimiter=". ",
        pattern=None, min_length=1,
    )


@query
def transform_retries(spark, sf):
    """Status and number of tries of each part; short output is asked for again."""
    parts = C.chunk_rows(C.chapter_rows(inputs.markdown_docs(spark, sf)), threshold=PART_TOKENS, delimiter=". ")
    done = C.transform_chunks(
        parts, lambda: str.lower, keys=["doc_id", "chapter_no", "part_no"], min_length=100, attempts=3
    )
    return done.groupBy("doc_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tries").alias("tries")
    )


@query
def transform_resumed(spark, sf):
    """The flagship with stored answers: labelled documents first, then all of them."""
    store = C.AnswerStore(spark, f"{_folder(spark, 'answers')}/answers", "lower case")
    docs = inputs.markdown_docs(spark, sf)
    options = dict(threshold=PART_TOKENS, delimiter=". ", pattern=None, min_length=1, answers=store)
    labelled = docs.join(table(spark, sf, "labels", "doc_id"), "doc_id", "left_semi")
    corpus.transform_markdown(labelled, lambda: str.lower, **options)
    return corpus.transform_markdown(docs, lambda: str.lower, **options)


@query
def heading_alignment(spark, sf):
    """What became of the headings of texts that lost their third line and got a new last one."""
    new = F.array(F.concat(F.lit("added "), "lang"))
    changed = F.concat(F.slice(lines(), 1, 2), F.filter(lines(), lambda x, i: i > 2), new)
    found = C.align_headings(inputs.markdown_docs(spark, sf), inputs.markdown_docs(spark, sf, changed))
    return found.groupBy("doc_id", "status", "heading").agg(F.count(F.lit(1)).alias("n"))


@query
def compare_structure(spark, sf):
    docs = inputs.markdown_docs(spark, sf)
    return C.compare_structure(docs, transform_roundtrip(spark, sf))


# --- views ----------------------------------------------------------------------


def _view_docs(spark, sf):
    return documents(spark, sf, "lang", "source", "text", "n_chars").select(
        text_of("doc_id").alias("key"),
        F.replace("text", F.lit("\n"), F.lit(" ")).alias("title"),
        F.col("n_chars").alias("total_citation"),
        F.col("lang").alias("subtitle"),
        F.when(F.col("lang") != "es", F.col("source")).alias("tldr"),
        F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/")).alias("original"),
        F.concat(F.lit("10.5555/"), "source").alias("doi"),
        F.col("text").alias("review"),
    )


@query
def overview(spark, sf):
    return V.overview(_view_docs(spark, sf))


@query
def links_view(spark, sf):
    return V.links_view(
        _view_docs(spark, sf), reader_root="reader/", slide_root="http://localhost/slides/"
    )


@query
def review_page(spark, sf):
    docs = _view_docs(spark, sf).withColumn("graphical_abstract", F.col("tldr")).withColumn(
        "bibliography", F.lit(None).cast("string")
    )
    return V.review_page(docs)


# --- incremental ------------------------------------------------------------------


@query
def latest_ingested(spark, sf):
    """The last event of each user, by state across two runs; the second adds nothing."""
    folder = _folder(spark, "latest")
    store = BucketStore(spark, f"{folder}/table", ("user_id",), 8, ("event_id",))
    schema = table(spark, sf, "events").schema
    for n in range(2):
        stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]").select("user_id", "event_id", "event_type")
        ingest.ingest_latest(stream, store, f"{folder}/checkpoint", stage=f"{folder}/stage{n}")
    return store.read().select("user_id", "event_id", "event_type")


@query
def incremental_ids(spark, sf):
    """Ids of an event stream, each stored once; a second run adds nothing."""
    folder = f"{ingest.work_dir(spark)}/incremental-{uuid.uuid4().hex}"
    store, checkpoint = f"{folder}/ids", f"{folder}/checkpoint"
    schema = table(spark, sf, "events").schema.simpleString()[len("struct<"):-1].replace(":", " ")
    for _ in range(2):
        # a pattern matches the table, be it a file or a directory of part files
        stream = ingest.id_stream(spark, f"{sf}/events.parque[t]", schema, "user_id")
        ingest.ingest_new_ids(stream, store, checkpoint)
    return spark.read.parquet(store).select("id")


