"""Odd inputs that once gave wrong answers or ended a job."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from scholarflow.functions import text as X
from scholarflow.operators import chunks as C
from scholarflow.operators import papers as A
from scholarflow.plans import corpus
from scholarflow.plans.queries import QUERIES
from scholarflow.sources import readers as R
from scholarflow.streaming import ingest


def test_character_references(spark):
    given = {
        "it&apos;s": "it's", "&lbrack;1&rbrack;": "[1]", "&#00000000039;": "'", "&#150;&#x96;": "––",
        "&#0;&#xD800;&#99999999999999999999;": "���", "&#x1F600;": "😀", "&nosuchname;": "&nosuchname;",
        "&ThickSpace;": "\u205f\u200a", "&amp;lt; & &#; &;": "&lt; & &#; &;", "&#129;": "\x81",
    }
    rows = spark.createDataFrame([(k,) for k in given], "x string").select("x", X.unescape_html("x").alias("y")).collect()
    assert {r.x: r.y for r in rows} == given


def test_greater_sign_inside_attributes(spark):
    html = '<article><h2>T</h2><p title="a>b" class=\'c>d\'>one <i title=">">two</i></p><p title="open>three</p></article>'
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    from scholarflow.functions import html as H

    found = pages.select(F.regexp_extract_all("html", F.lit(H.TOKEN_PATTERN), 0).alias("t")).first().t
    assert found == [
        "<article>", "<h2>", "T", "</h2>", "<p title=\"a>b\" class='c>d'>", "one ", '<i title=">">', "two", "</i>", "</p>",
        '<p title="open>', "three", "</p>", "</article>",
    ]


def test_dates_and_unreadable_payloads(spark):
    raw = spark.createDataFrame(
        [("a", json.dumps({"title": "A", "publicationDate": "Spring 2019"})), ("b", '{"title": "cut'),
         ("c", json.dumps({"title": "C", "publicationDate": "2020-02-03"})), ("d", "no json"),
         ("e", json.dumps({"title": "E", "year": "soon"}))],
        "paper_id string, payload string",
    )
    none = spark.createDataFrame([], "doi string, url string")
    journals = spark.createDataFrame([("X", "x", 0)], "journal string, name_short string, ordinal int")
    rows = {r.semantic_id: (r.title, str(r.date)) for r in A.normalise_papers(raw, none, journals).collect()}
    assert rows == {"a": ("A", "None"), "c": ("C", "2020-02-03"), "e": ("E", "None")}
    assert sorted(r.paper_id for r in A.unreadable_answers(raw).collect()) == ["b", "d"]


def test_answer_that_is_none(spark):
    def make():
        return lambda text: None if "x" in text else text * 200

    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "part_no int, text string")
    rows = {r.part_no: r for r in C.transform_chunks(chunks, make, keys=["part_no"]).collect()}
    assert rows[1].status == "error" and rows[1].output is None and "TypeError" in rows[1].error
    assert rows[2].status == "ok"


def test_journals_by_name(spark, tmp_path):
    (tmp_path / "b.csv").write_text('name_short,journal\nXY,"The ""X"" and Y"\nZZ,Z\n')
    (tmp_path / "a.csv").write_text("journal,name_short\nZ,FIRST\n")
    rows = A.first_journals(R.read_journals(spark, str(tmp_path / "b.csv"))).orderBy("ordinal").collect()
    assert [(r.journal, r.name_short) for r in rows] == [('The "X" and Y', "XY"), ("Z", "ZZ")]


def test_upsert_by_order_of_writes(spark):
    old = spark.createDataFrame([(1, "old", 9)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "late", 3), (1, "early", 2), (2, "n", 1)], "k int, v string, t int")
    for rows in (new, new.orderBy("t"), new.repartition(3)):
        found = A.upsert(old, rows, ["k"], written=["t"]).collect()
        assert sorted((r.k, r.v) for r in found) == [(1, "late"), (2, "n")]


def test_page_that_landed_twice(spark):
    page = lambda text: f'<div class="section" id="s1"><h2>{text}</h2><p>{text}</p></div>'
    pages = spark.createDataFrame([(1, "7", page("old"), 1), (1, "7", page("new"), 2)], "page_id long, document_id string, html string, landed int")
    papers = spark.createDataFrame([("s7", {"SEMANTIC": "s7", "IEEE": "7"})], "semantic_id string, external_ids map<string,string>")
    dois = spark.createDataFrame([], "ieee_id string, doi string")
    answers = spark.createDataFrame([], "doi string, status int, paper_id string")
    refs = spark.createDataFrame([], "page_id long, html string")
    built = corpus.build_corpus(pages, refs, papers, dois, answers, landed="landed")
    assert [r.markdown.count("new") > 0 and "old" not in r.markdown for r in built.markdown.collect()] == [True]


@pytest.mark.parametrize("parts", [1, 3])
def test_incremental_ids_of_a_directory_table(spark, tmp_path, parts):
    rows = spark.range(40).select((F.col("id") % 7).alias("user_id"))
    rows.repartition(parts).write.parquet(str(tmp_path / "events.parquet"))
    found = QUERIES["incremental_ids"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in found) == sorted(str(i) for i in range(7))


def test_batches_read_no_stored_rows(spark, tmp_path):
    """What is known is state: the store may go, and known ids still are not new."""
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "check"))
    for n, ids in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(i,) for i in ids], "k string").write.mode("append").parquet(source)
        target = f"{store}{n}"  # another table each time: nothing of the first can be read
        ingest.ingest_new_ids(ingest.id_stream(spark, source, "k string", "k"), target, checkpoint)
    assert [r.id for r in spark.read.parquet(f"{store}1").collect()] == ["c"]


def test_shared_folder_is_demanded_on_a_cluster():
    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ingest.work_dir(SimpleNamespace(conf=conf, sparkContext=context))


