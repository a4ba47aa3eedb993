import pytest
from pyspark.sql import functions as F

from scholarflow.operators import chunks as C
from scholarflow.operators import views as V
from scholarflow.plans import corpus

TEXT = "---\nt: x\n---\n\n# A\n\nintro words here\n\n## B\n\nb1 b2 b3\n\nb4 b5 b6\n\nb7\n## D\nd"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", TEXT), ("b", "no header\n\n## x"), ("c", "---\nonly: header\n---"), ("d", ""), ("e", None)]
    return spark.createDataFrame(rows, "doc_id string, markdown string")


def test_chapter_rows(docs):
    got = C.chapter_rows(docs).where("doc_id = 'a'").orderBy("chapter_no").collect()
    assert [(r.chapter_no, r.text) for r in got] == [
        (0, "---\nt: x\n---"), (1, "# A\n\nintro words here"),
        (2, "## B\n\nb1 b2 b3\n\nb4 b5 b6\n\nb7"), (3, "## D\nd"),
    ]
    whole = C.chapter_rows(docs, with_header=False).where("doc_id = 'a'").orderBy("chapter_no").collect()
    assert whole[0].text == "" and whole[1].text.startswith("---\nt: x")


def test_chunks_rejoin(docs):
    chapters = C.chapter_rows(docs)
    parts = C.chunk_rows(chapters, threshold=3)
    joined = parts.groupBy("doc_id", "chapter_no").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(part_no, text))), x -> x.text), '')").alias("text")
    )
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, chapters.collect()))
    plan = C.chunk_plan(chapters, threshold=3).select("doc_id", "chapter_no", "n_parts").collect()
    counts = parts.groupBy("doc_id", "chapter_no").count().collect()
    expected = {(r.doc_id, r.chapter_no): 1 if r.chapter_no == 0 else r.n_parts for r in plan}
    assert {(r.doc_id, r.chapter_no): r["count"] for r in counts} == expected


def test_native_and_callable_agree(docs):
    native = C.transform_in_place(docs, F.upper, threshold=3)
    called = corpus.transform_markdown(docs, lambda: str.upper, threshold=3, pattern=None, min_length=0)
    want = {r.doc_id: (r.n_chunks, r.markdown) for r in native.collect()}
    assert {r.doc_id: (r.n_chunks, r.markdown) for r in called.collect()} == want
    assert set(want) == {"a", "b", "c", "d"}
    whole = {r.doc_id: r.markdown for r in C.transform_in_place(docs, lambda c: c).collect()}
    assert whole["a"] == (
        "---\nt: x\n---\n\n\n\n# A\n\nintro words here\n\n## B\n\nb1 b2 b3\n\nb4 b5 b6\n\nb7\n\n## D\nd"
    )
    assert whole["c"] == "---\nonly: header\n---\n\n" and whole["d"] == ""


def test_observed(docs):
    parts, seen = C.observed(C.chunk_rows(C.chapter_rows(docs), threshold=3), "parts")
    rows = parts.collect()
    assert seen.get == {"rows": len(rows), "characters": sum(len(r.text) for r in rows)}


def test_own_counter(docs):
    chapters = C.chapter_rows(docs)
    words = C.counter_of(lambda: lambda text: len(text.split()))
    plan = C.chunk_plan(chapters, threshold=3, counter=words)
    for r in plan.collect():
        n = len(r.text.split())
        assert (r.n_tokens, r.n_parts) == (n, n // 3 + 1 if n > 3 else 1)
    parts = C.chunk_rows(chapters, threshold=3, counter=words)
    assert parts.where("doc_id = 'a' and chapter_no = 2").count() == 4


def test_staged_transform(docs, tmp_path):
    plain = corpus.transform_markdown(docs, lambda: str.upper, threshold=3).collect()
    staged = corpus.transform_markdown(docs, lambda: str.upper, threshold=3, stage=str(tmp_path), tasks=3).collect()
    assert sorted(plain) == sorted(staged)


def test_retries_and_errors(spark):
    def flaky():
        seen = {}

        def run(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "boom":
                raise ValueError("no")
            return text * 40 if seen[text] == 2 and text == "later" else text

        return run

    chunks = spark.createDataFrame(
        [(1, "later"), (2, "short"), (3, "boom"), (4, "  "), (5, "x" * 200)], "part_no int, text string"
    )
    rows = {r.part_no: r for r in C.transform_chunks(chunks, flaky, keys=["part_no"]).collect()}
    assert {k: (r.status, r.tries) for k, r in rows.items()} == {
        1: ("ok", 2), 2: ("short", 3), 3: ("error", 1), 4: ("blank", 0), 5: ("ok", 1)}
    assert rows[2].output == "short" and rows[4].output == "  "
    assert rows[3].output is None and rows[3].error == "ValueError: no"


def test_compare_structure(docs):
    same = C.compare_structure(docs, C.transform_in_place(docs, F.lower))
    got = {r.doc_id: (r.source_chapters, r.same) for r in same.collect()}
    assert got["a"] == (3, True) and got["b"] == (2, True)
    lost = docs.withColumn("markdown", F.replace("markdown", F.lit("## "), F.lit("")))
    assert {r.doc_id: r.same for r in C.compare_structure(docs, lost).collect()}["a"] is False


def test_views(spark):
    docs = spark.sql(
        "select 'k' key, 'T' title, 3 total_citation, 'S' subtitle, cast(null as string) tldr, '/a/b/' original, "
        "'10.1/x' doi, cast(null as string) graphical_abstract, 'see $(bibliography)' review, 'B' bibliography"
    )
    assert V.overview(docs, only="k").first().Overview == "T<sup>3</sup><br>S<br><br>"
    assert V.overview(docs, only="other").count() == 0
    links = V.links_view(docs, reader_root="r/", slide_root="http://s/").first()
    assert (links.KR, links.EN) == ("[[r/a-b/zh|kr]]", "[[r/a-b/en|en]]")
    assert (links.Link, links.Slide) == ("[doi.org](https://doi.org/10.1/x)", "[slide](http://s/k.md)")
    page = V.review_page(docs).first().page
    assert "<!-- review -->\n\nsee $(bibliography)\n\n<!-- review -->" in page
    assert "<!-- graphical abstract -->\n\n\n\n<!-- graphical abstract -->" in page
