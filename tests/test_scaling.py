"""What a row costs must not grow with what surrounds it."""

import json
import re
import time

from pyspark.sql import functions as F

from scholarflow.functions import text as X
from scholarflow.operators import pages as P
from scholarflow.operators.scale import staged
from scholarflow.plans import corpus, inputs


def test_a_binding_keeps_its_type():
    # [0] derives the type of the array for every value, through all inner bindings
    assert X.sql_bind("a", "x_", "x_ + 1") == "element_at(transform(array(a), x_ -> x_ + 1), 1)"


def test_deep_bindings_keep_their_values(spark):
    out = "x_"
    for _ in range(14):
        out = X.sql_bind("x_ + 1", "x_", out)
    rows = spark.range(2000).select(F.expr(X.sql_bind("id", "x_", out)).alias("n"))
    assert rows.agg(F.sum("n")).first()[0] == sum(range(2000)) + 14 * 2000


def test_nesting_keeps_pages_apart(spark):
    html = ['<div class="section"><div class="figure"></div></div>', None, "", "<p>x</p>", '<div class="section"></div>']
    rows = spark.createDataFrame(list(enumerate(html)), "page_id int, html string").coalesce(1)
    got = P.outline(rows).orderBy("page_id").select(
        "owners", "places", F.size("heads").alias("sections"), F.size("figs").alias("figures")
    ).collect()
    assert [tuple(r) for r in got] == [
        ([0, 0, 0, -1], [0, 8, 0, 0], 1, 1), (None, None, None, None), ([-1], [0], 0, 0), ([-1], [0], 0, 0),
        ([0, -1], [0, 0], 1, 0),
    ]


def test_bare_closing_tags_are_pieces_like_others(spark):
    plain = '<div class="section"><div class="header"><h2>A</h2></div><ul><li>x</li></ul><div class="figure"></div></div>'
    spaced = plain.replace("</div>", "</div >").replace("</ul>", "</ul >")
    rows = spark.createDataFrame([(1, plain), (2, spaced)], "page_id int, html string")
    one, two = (P.sections(rows.where(F.col("page_id") == n)).drop("page_id").collect() for n in (1, 2))
    assert one == two and len(one) == 1


def test_lines_of_a_page_are_split_once(spark, tmp_path):
    spark.createDataFrame(
        [(1, "a\nb\nc", "en", "s"), (2, None, "en", "s")], "doc_id long, text string, lang string, source string"
    ).write.parquet(str(tmp_path / "documents.parquet"))
    pages = inputs.publisher_pages(spark, str(tmp_path))
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    html = [r.html for r in pages.orderBy("page_id").collect()]
    assert html[1] is None and [f"of {n}</p>" in html[0] for n in (2, 3)] == [False, True]


def test_reference_entries_come_from_the_page_row(spark):
    pages = spark.createDataFrame([(1, "")], "page_id long, html string")
    plan = P.reference_links(pages)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Window", "Sort ", "Exchange", "Aggregate") if x in plan]


def test_reference_entries_of_broken_pages(spark):
    html = [
        # a column ahead of any entry; stray closing tags; an open list keeps the title open
        '</div><div class="col"><div>early</div></div></span><div class="reference-container"><span class="number"><i>x</i>'
        '</span><span class="number"><b> 1 </b><b>2</b></span><div class="col"> <div>a <ul>b</div> c</div><div>d',
        # an entry inside an entry; of two titles the first one counts; links of two boxes
        '<div class="reference-container"><div class="col">x<div class="reference-container"><div class="col">\n<div>in</div>'
        '<span class="ref-link"><a href="/1">A</a></span></div><div class="col"><div>second</div><span class="ref-link">'
        "<a>B</a><a href='/2'>C</a></span></div></div></div></div>",
        None, "", "<p>no entry</p>",
    ]
    pages = spark.createDataFrame(list(enumerate(html)), "page_id int, html string").coalesce(1)
    got = [(r.page_id, r.ordinal, r.number, r.title, [tuple(f) for f in r.found]) for r in P.reference_links(pages).collect()]
    assert sorted(got, key=lambda r: (r[0], -1 if r[1] is None else r[1])) == [
        (0, None, None, "early", []), (0, 0, "1", "a b c", []), (1, 0, None, None, []),
        (1, 1, None, "in", [("A", "/1"), ("B", None), ("C", "/2")]),
    ]


def moved(df):
    """The columns that each shuffle of a plan takes along."""
    explained = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = df._jdf.queryExecution().explainString(explained)
    return [re.findall(r"(\w+)#", x) for x in re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)]


def test_a_staged_table_leaves_no_shuffles(spark, tmp_path):
    """What was shuffled for a table takes no disk once the table is there."""
    def stored():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return {int(n) for n in re.findall(r"shuffle_(\d+)_", files)}

    before = max(stored(), default=-1)
    rows = spark.range(1000).selectExpr("id % 10 as k", "id as v")
    tables = [
        staged(rows.groupBy("k").agg(F.collect_list("v").alias("v")), str(tmp_path / "a")),
        staged(rows.repartition("k"), str(tmp_path / "b"), by="k"),
    ]
    for _ in range(40):
        left = {n for n in stored() if n > before}
        if not left:
            break
        time.sleep(0.5)
    assert not left
    assert tables[0].selectExpr("sum(size(v))").first()[0] == tables[1].count() == 1000


def test_a_table_staged_by_a_key_meets_without_moving(spark, tmp_path):
    rows = spark.range(200).selectExpr("id % 50 as k", "array(struct(id as v, 'x' as `a b`)) as l")
    one, two = (staged(rows.where(f"l[0].v % 2 = {n}"), str(tmp_path / str(n)), by="k") for n in range(2))
    counts = [t.groupBy("k").agg(F.count(F.lit(1)).alias(f"n{n}")) for n, t in enumerate((one, two))]
    both = counts[0].join(counts[1].hint("merge"), "k", "full")
    assert moved(both) == [] and moved(rows.groupBy("k").count()) == [["k", "count"]]
    assert both.count() == 50 and one.dtypes == rows.dtypes
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("staged_")]


def test_records_move_places_and_ids_only(spark, tmp_path):
    """Texts stay with their page: pages and their references are stored by page_id."""
    page = lambda x: f'<div class="section" id="s1"><div class="header"><h2>{x}</h2></div><p>{x}</p></div>'

    def entry(x, doi):
        return (
            f'<div class="reference-container"><div class="number"><b>1.</b></div><div class="col"><div>{x}</div>'
            f'<span class="ref-link"><a href="https://doi.org/{doi}">CrossRef</a></span></div></div>'
        )

    pages = spark.createDataFrame(
        # a page with an old version and two copies of the new one, one without an id, one without references
        [(1, "71", page("old"), 1), (1, "71", page("new"), 2), (1, "71", page("new"), 2), (2, "72", page("two"), 1),
         (3, "none", page("none"), 1), (None, "71", page("lost"), 9), (4, "74", None, 1)],
        "page_id int, document_id string, html string, landed int",
    )
    refs = spark.createDataFrame(
        [(1, entry("a", "10.1/x") + entry("b", "10.1/y")), (1, entry("c", "10.1/x")), (1, entry("c", "10.1/x")), (3, entry("d", "10.1/x")), (2, None)],
        "page_id int, html string",
    )
    papers = spark.createDataFrame(
        [(f"S{n}", {"IEEE": f"7{n}", "SEMANTIC": f"S{n}"}) for n in (1, 2, 4)] + [("S9", {"DOI": "10.1/x", "SEMANTIC": "S9"})],
        "semantic_id string, external_ids map<string,string>",
    )
    dois = spark.createDataFrame([], "ieee_id string, doi string")
    answers = spark.createDataFrame([], "doi string, status int, paper_id string")
    for stage in (None, str(tmp_path / "stage")):
        built = corpus.build_corpus(pages, refs, papers, dois, answers, stage=stage, landed="landed")
        records = built.records(output_dir="o", image_dir="i", info_dir="n")
        got = {r.page_id: json.loads(r.record) for r in records.collect()}
        assert sorted(got) == [1, 2, 4]
        assert [(r["title"], r["semantic"]) for r in got[1]["reference_info"]] == [("a", "S9"), ("c", "S9"), ("c", "S9"), ("b", None)]
        assert [s["title"] for s in got[1]["section_info"]] == ["new"]
        assert got[2]["reference_info"] == [] == got[4]["section_info"]
        assert sorted((r.page_id, r.title, r.semantic_id or "") for r in built.references.collect()) == [
            (1, "a", "S9"), (1, "b", ""), (1, "c", "S9"), (1, "c", "S9")]
    # as with tables too large to send to every task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        columns = {c for shuffle in moved(built.records(output_dir="o", image_dir="i", info_dir="n")) for c in shuffle}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not columns & {"html", "sections", "content", "title", "entries", "found"} and "place" in columns
