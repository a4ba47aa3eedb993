"""Inputs for the registered queries, derived row by row from the given tables.

The given texts hold no headings, DOIs or publisher mark-up, so these functions
wrap whole texts in them. Each output row comes from one input row, so the
inputs grow with the tables and no row outgrows its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarflow.functions import text as X
from scholarflow.operators.pages import Box, PageLayout

# Raw web pages: every region of the page is a section.
WEB_PAGE = PageLayout(
    boxes=(
        Box("section", ("nav", "article", "footer")),
        Box("section", ("div",), ("ad",)),
    ),
    heading_levels=(1, 6),
    trigger_levels=(1, 6),
)
JOURNALS = (
    ("Bolt Letters", "BL"),
    ("bolt", "BOLT"),
    ("RED WIDGET", "RW"),
    ("widget", "WDG"),
    ("of Promo", "PRO"),
    ("bolt", "BLT"),
    ("100%", "PCT"),
    ("Gear", "GR"),
    ("gear", "GEAR"),
    ("of economy", "ECO"),
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", *columns)


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "html")


def text_of(name: str) -> Column:
    return F.col(name).cast("string")


def lines(c: str = "text") -> Column:
    return F.split(c, "\n", -1)


def fill(template: str, **values: Column) -> Column:
    """The template with each {{name}} replaced by a column."""
    parts: list[Column] = []
    for i, piece in enumerate(template.split("{{")):
        if i:
            name, piece = piece.split("}}", 1)
            parts.append(values[name].cast("string"))
        parts.append(F.lit(piece))
    return F.concat(*parts)


def markdown_docs(spark: SparkSession, sf_dir: str, chapters: Column | None = None) -> DataFrame:
    """(doc_id, markdown): front matter, a title, and a chapter per text line, or per given line."""
    md = fill(
        "---\nlang: {{lang}}\nsource: {{source}}\n---\n\n# {{source}}\n\n{{body}}",
        lang=F.col("lang"), source=F.col("source"),
        body=F.array_join(lines() if chapters is None else chapters, "\n\n## "),
    )
    return documents(spark, sf_dir, "lang", "source", "text").select("doc_id", md.alias("markdown"))


SECTION = (
    '<div class="section" id="sec{{i}}"><div class="header article-hdr"><div class="kicker">'
    "SECTION {{next}}.</div><h2>{{source}} – {{lang}} ({{next}})</h2></div><p>{{text}} See "
    '<a ref-type="sec" anchor="sec{{next}}">next</a>, <a ref-type="fig" anchor="fig{{i}}">'
    'Fig. {{i}}</a> and <a ref-type="bibr" anchor="ref{{i}}">[{{i}}]</a>.</p>'
    '<div class="section_2" id="sec{{i}}a"><h3>Notes {{next}}</h3><p>Length <inline-formula>'
    '<script type="math/tex">n_{{i}}\n<{{len}}</script></inline-formula>, <i>{{lang}}</i> '
    "<b>{{source}}</b>.<p>unclosed<ul><li>chars {{len}}<b>x</b></li><li><p>words "
    '<sub>{{i}}</sub></p></li></ul></div><div class="figure figure-full" id="fig{{i}}">'
    '<div class="img-wrap"><a href="/mediastore/{{doc}}-{{i}}.gif"><img alt="Fig\n{{i}}"></a></div>'
    '<div class="figcaption"><b class="title">Fig. {{i}}.</b><p>Line <i>{{i}}</i> of {{n}}</p>'
    "</div></div></div>"
)


def publisher_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, document_id, semantic_id, html): an article page per document,
    a section per text line, with links to the next section and to a figure
    further down."""
    # split once a page, not again for every line
    docs = documents(spark, sf_dir, "lang", "source", "text").withColumn("lines", lines())
    section = F.transform("lines", lambda x, i: fill(
        SECTION, i=i, next=i + 1, source=F.col("source"), lang=F.col("lang"),
        text=X.escape_html(x), len=F.length(x), doc=F.col("doc_id"), n=F.size("lines"),
    ))
    return docs.select(
        F.col("doc_id").alias("page_id"),
        text_of("doc_id").alias("document_id"),
        F.concat(F.lit("S"), "doc_id").alias("semantic_id"),
        F.concat(F.lit('<html><body><div id="article">'), F.array_join(section, ""), F.lit("</div></body></html>")).alias("html"),
    )


LINK_KINDS = ("bibr", "fn", "disp-formula", "algorithm", "lemma", "theorem", "graphic", "fig", "table", "sec", "odd")
RICH = (
    '<div class="section" id="sec{{i}}"><div class="header"><h2>Part {{next}}</h2></div><p>{{text}}<sup>{{i}}</sup> '
    "<monospace>m{{i}}</monospace>"
    + "".join(
        f' <a ref-type="{k}" anchor="{k}{{{{{"next" if k == "sec" else "i"}}}}}">{k} {{{{i}}}}</a>' for k in LINK_KINDS
    )
    + ' <disp-formula><span class="tex tex2jax_ignore">P_{{i}}=\nq</span></disp-formula></p>'
    '<disp-formula><span class="tex tex2jax_ignore">E_{{i}}=\nmc</span></disp-formula>'
    "<ol><li>one {{i}}</li><li>two<b>x</b></li></ol>"
    '<div class="figure" id="fig{{i}}"><div class="img-wrap"><a href="/m/{{i}}.gif"><img alt="A"></a></div></div>'
    '<div class="table" id="table{{i}}"><div class="img-wrap"><a href="/t/{{i}}.gif"><img alt="T {{i}}"></a></div>'
    '<div class="figcaption"><b class="title">Table {{i}}</b><p>of {{doc}}</p></div></div></div>'
)


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with numbered lists, display formulas, all kinds of links, and figures of which one has no caption."""
    section = F.transform(lines(), lambda x, i: fill(RICH, i=i, next=i + 1, text=X.escape_html(x), doc=F.col("doc_id")))
    return documents(spark, sf_dir, "text").select(
        F.col("doc_id").alias("page_id"), text_of("doc_id").alias("document_id"),
        F.concat(F.lit("S"), "doc_id").alias("semantic_id"), F.array_join(section, "").alias("html"),
    )


REFERENCE = (
    '<div class="reference-container"><div class="row"><div class="number col-auto"><b>{{next}}.'
    '</b></div><div class="col"><div>{{text}}</div><div class="ref-links-container">{{links}}'
    "</div></div></div></div>"
)


def reference_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): a reference page per document, an entry per text line.

    The first entry links to a publisher page and then to a DOI that few
    papers share; the others to a DOI that very many share, and those with a
    comma to a publisher page after it.
    """
    def link(href: Column, text: str) -> Column:
        return F.concat(F.lit('<span class="ref-link"><a href="'), href, F.lit(f'">{text}</a></span>'))

    def entry(x: Column, i: Column) -> Column:
        page = link(F.concat(F.lit("/document/"), F.length(x).cast("string")), "View Article")
        own = link(F.concat(F.lit("https://doi.org/10.5555/"), "source"), "CrossRef")
        shared = link(F.concat(F.lit("https://doi.org/10.5555/"), "lang"), " CrossRef ")
        links = (
            F.when(i == 0, F.concat(page, own))
            .when(F.contains(x, F.lit(",")), F.concat(shared, page))
            .otherwise(shared)
        )
        return fill(REFERENCE, next=i + 1, text=X.escape_html(x), links=links)

    return documents(spark, sf_dir, "lang", "source", "text").select(
        F.col("doc_id").alias("page_id"),
        F.array_join(F.transform(lines(), entry), "").alias("html"),
    )


def labelled_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(semantic_id, external_ids): the stored papers are the labelled documents."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "n_chars")
    rows = docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_semi")
    sid = F.concat(F.lit("S"), "doc_id")
    return rows.select(
        sid.alias("semantic_id"),
        F.create_map(
            F.lit("SEMANTIC"), sid,
            F.lit("DOI"), F.concat(F.lit("10.5555/"), "source"),
            F.lit("IEEE"), text_of("n_chars"),
        ).alias("external_ids"),
    )


def language_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doi, status, paper_id): landed answers, one per document; Spanish ones failed."""
    return table(spark, sf_dir, "documents", "doc_id", "lang").select(
        F.concat(F.lit("10.5555/"), "lang").alias("doi"),
        F.when(F.col("lang") == "es", 404).otherwise(200).alias("status"),
        F.concat(F.lit("A"), "doc_id").alias("paper_id"),
    )


def page_number(url: str = "url") -> Column:
    return X.capture(url, r"/([0-9]+)")


def page_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ieee_id, doi): a web page's number leads to the DOI of its language."""
    return table(spark, sf_dir, "pages", "url").select(
        page_number().alias("ieee_id"),
        F.concat(F.lit("10.5555/"), F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("doi"),
    )


def numbered_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as papers with a DOI of their own; good ones also
    have a publisher id."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    sid = F.concat(F.lit("S"), "doc_id")
    return labels.select(
        sid.alias("semantic_id"),
        F.create_map(
            F.lit("SEMANTIC"), sid,
            F.lit("DOI"), F.concat(F.lit("10.5555/d"), "doc_id"),
            F.lit("IEEE"), F.when(F.col("quality") == 1, text_of("doc_id")),
        ).alias("external_ids"),
    )


def numbered_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed answers for the documents without a label; Spanish ones failed."""
    docs = table(spark, sf_dir, "documents", "doc_id", "lang")
    return docs.join(table(spark, sf_dir, "labels", "doc_id"), "doc_id", "left_anti").select(
        F.concat(F.lit("10.5555/d"), "doc_id").alias("doi"),
        F.when(F.col("lang") == "es", 404).otherwise(200).alias("status"),
        F.concat(F.lit("A"), "doc_id").alias("paper_id"),
    )


def publisher_url(url: str = "url") -> Column:
    """The web page's url with .org hosts as one publisher, .net as another."""
    ieee = F.regexp_replace(url, r"://[^/]*\.org/[a-z]+/", "://ieeexplore.ieee.org/document/")
    return F.regexp_replace(ieee, r"://[^/]*\.net/[a-z]+/", "://dl.acm.org/doi/10.1145/")


def url_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as papers: several share a publisher id; ORG is often NULL."""
    sid = text_of("page_id")
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        sid.alias("semantic_id"),
        F.create_map(
            F.lit("SEMANTIC"), sid,
            F.lit("IEEE"), page_number(),
            F.lit("ORG"), X.capture("url", r"://([^/]*\.org)/"),
        ).alias("external_ids"),
    )


def journals(spark: SparkSession) -> DataFrame:
    rows = [(j, s, i) for i, (j, s) in enumerate(JOURNALS)]
    return spark.createDataFrame(rows, "journal string, name_short string, ordinal int")


def part_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    venue = F.concat("p_name", F.lit(" Letters of "), F.lower("p_type"))
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").select(
        "p_partkey", venue.alias("venue")
    )


def raw_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, payload): an API answer per document; Spanish ones lack a title."""
    payload = F.struct(
        F.when(F.col("lang") != "es", lines()[0]).alias("title"),
        F.array(
            F.struct(F.col("source").alias("name"), F.lit("1").alias("authorId")),
            F.struct(F.col("lang").alias("name"), F.lit("2").alias("authorId")),
        ).alias("authors"),
        (F.size(lines()) + 1900).alias("year"),
        F.concat(F.col("source"), F.lit(" Bolt Letters of "), "lang").alias("venue"),
        F.concat(F.lit("$\\alpha  $ "), "text").alias("abstract"),
        F.col("n_chars").alias("citationCount"),
        F.create_map(
            F.lit("DOI"), F.concat(F.lit("10.5555/p"), "doc_id"),
            F.lit("CorpusId"), text_of("doc_id"),
        ).alias("externalIds"),
        F.lit("2019-06-03").alias("publicationDate"),
    )
    return documents(spark, sf_dir, "lang", "source", "text", "n_chars").select(
        F.concat(F.lit("S"), "doc_id").alias("paper_id"), F.to_json(payload).alias("payload")
    )


def resolved_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url").select(
        F.concat(F.lit("10.5555/p"), "page_id").alias("doi"), publisher_url().alias("url")
    )


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, direction, payload): a reference per text line. Documents of
    one line have an empty list, German ones no list at all."""
    edge = F.transform(lines(), lambda x, i: F.struct(
        F.array(F.col("lang"), F.lit("background")).alias("intents"),
        (F.length(x) > 80).alias("isInfluential"),
        F.struct(
            F.concat(F.lit("P"), F.length(x)).alias("paperId"),
            x.alias("title"),
            (i + 1990).alias("year"),
            F.col("source").alias("venue"),
        ).alias("citedPaper"),
    ))
    listed = F.when(F.size(lines()) > 1, edge).otherwise(F.slice(edge, 1, 0))
    payload = F.when(F.col("lang") == "de", "{}").otherwise(F.to_json(F.struct(listed.alias("data"))))
    return documents(spark, sf_dir, "lang", "source", "text").select(
        text_of("doc_id").alias("paper_id"), F.lit("reference").alias("direction"),
        payload.alias("payload"),
    )


def raw_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, direction, payload): a citation per text line. English documents nest the citing
    paper, French ones are the bare list of flat edges, others list flat edges."""
    paper = lambda x, i: [
        F.concat(F.lit("P"), F.length(x)).alias("paperId"), x.alias("title"), (i + 1990).alias("year"), F.col("source").alias("venue"),
    ]
    told = lambda x: [
        F.array(F.col("lang")).alias("intents"), (F.length(x) > 80).alias("isInfluential"),
    ]
    nested = F.transform(lines(), lambda x, i: F.struct(*told(x), F.struct(*paper(x, i)).alias("citingPaper")))
    flat = F.transform(lines(), lambda x, i: F.struct(*told(x), *paper(x, i)))
    payload = (
        F.when(F.col("lang") == "en", F.to_json(F.struct(nested.alias("data"))))
        .when(F.col("lang") == "fr", F.to_json(flat)).otherwise(F.to_json(F.struct(flat.alias("data"))))
    )
    return documents(spark, sf_dir, "lang", "source", "text").select(
        text_of("doc_id").alias("paper_id"), F.lit("citation").alias("direction"), payload.alias("payload")
    )
