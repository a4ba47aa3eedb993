"""Readers, writers, incremental ingest and the whole corpus job on files."""

import json

from pyspark.sql import functions as F

from scholarflow.operators import edges as E
from scholarflow.operators import papers as A
from scholarflow.plans import corpus
from scholarflow.sources import readers as R
from scholarflow.sources import sinks as K
from scholarflow.streaming import ingest


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".").replace("_dash_", "-")).write_text(text, encoding="utf-8")
    return str(folder)


def test_id_list_and_journals(spark, tmp_path):
    ids = put(tmp_path / "ids", new__txt=" a \n\n b\nb\n")
    assert [r.id for r in R.read_id_list(spark, ids).collect()] == ["a", "b", "b"]
    csv = put(tmp_path / "csv", journals__csv='journal,name_short\n"X, Y",XY\nZ,ZZ\n"X, Y",X2\n')
    first = A.first_journals(R.read_journals(spark, csv)).orderBy("ordinal").collect()
    assert [(r.journal, r.name_short) for r in first] == [("X, Y", "X2"), ("Z", "ZZ")]


def test_paper_files(spark, tmp_path):
    path = put(
        tmp_path / "papers",
        a__yaml="title: Tïtle\ndate: 2020-02-03\nauthors: [A, B]\nyear: 2020\ncitation_count: 5\n"
                "external_ids: {SEMANTIC: a, IEEE: '55', ACM: null, CorpusId: 7}\n",
        b__yml="title: T2\nyear: Unknown Year\nexternal_ids: {IEEE: null}\n",
        c__json='{"title": "J", "external_ids": {"IEEE": "9"}}',
        bad__yaml="title: [unclosed",
        list__yaml="- 1\n- 2\n",
        other__txt="title: no",
    )
    rows = {r.semantic_id: r for r in R.read_paper_files(spark, path).collect()}
    assert sorted(rows) == ["a", "b", "bad", "c", "list"]
    assert rows["a"].external_ids == {"SEMANTIC": "a", "IEEE": "55", "ACM": None, "CorpusId": "7"}
    assert (rows["a"].title, str(rows["a"].date), rows["a"].authors, rows["a"].year) == ("Tïtle", "2020-02-03", ["A", "B"], 2020)
    assert rows["b"].year is None and rows["bad"]._corrupt and rows["list"]._corrupt
    good = R.read_paper_files(spark, path).where("_corrupt is null")
    assert sorted(r.semantic_id for r in A.papers_with_id(good).collect()) == ["a", "c"]
    only = R.read_paper_files(spark, path, endings=(".yaml",))
    assert sorted(r.semantic_id for r in only.collect()) == ["a", "bad", "list"]
    keys = R.file_keys(spark, path, ends_with=(".yaml", ".yml"))
    assert sorted(r.key for r in keys.collect()) == ["a", "b", "bad", "list"]


def test_edge_files_and_sink(spark, tmp_path):
    edge = json.dumps([{"citingPaper": {"paperId": "z"}, "isInfluential": False}])
    path = put(tmp_path / "cit", p1_dash_citation__json=edge, p2_dash_citation__json="[]")
    edges = E.flatten_edges(R.read_edge_files(spark, path, "citation"))
    assert [(r.paper_id, r.other_id) for r in edges.collect()] == [("p1", "z")]
    keys = R.file_keys(spark, path, ends_with=(".json",), suffix="-citation")
    assert sorted(r.key for r in keys.collect()) == ["p1", "p2"]
    out = str(tmp_path / "edges")
    K.write_edges(edges, out)
    plan = spark.read.parquet(out).where("direction = 'citation'")
    assert plan.count() == 1
    assert "PartitionFilters: [isnotnull(direction" in plan._jdf.queryExecution().toString()


def test_markdown_files(spark, tmp_path):
    path = put(tmp_path / "md", one__md="# A\n\n## B", two__md="x")
    docs = R.read_markdown(spark, path)
    assert {r.doc_id: r.markdown for r in docs.collect()} == {"one": "# A\n\n## B", "two": "x"}
    K.write_markdown_files(docs, str(tmp_path / "table"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect())) == sorted(map(tuple, docs.collect()))
    K.write_markdown_files(docs, str(tmp_path / "out"), one_file_each=True)
    files = list((tmp_path / "out" / "doc_id=one").glob("*.txt"))
    assert [f.read_text(encoding="utf-8").rstrip("\n") for f in files] == ["# A\n\n## B"]


def test_incremental_ingest(spark, tmp_path):
    source, store, checkpoint = (str(tmp_path / n) for n in ("in", "store", "check"))

    def add(*ids):
        spark.createDataFrame([(i,) for i in ids], "k string").coalesce(1).write.mode("append").parquet(source)

    def run():
        ingest.ingest_new_ids(ingest.id_stream(spark, source, "k string", "k"), store, checkpoint)
        return sorted(r.id for r in spark.read.parquet(store).collect())

    add("a", " b ", "b", "", "a")
    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    add("b", "c", None)
    assert run() == ["a", "b", "c"]


def test_replayed_batch_writes_once(spark, tmp_path):
    """A batch that runs again after a failure replaces its own rows."""
    store = str(tmp_path / "store")
    source = str(tmp_path / "in")
    spark.createDataFrame([("a",), ("b",)], "k string").write.parquet(source)
    for n in range(2):  # a lost checkpoint replays batch 0
        ingest.ingest_new_ids(
            ingest.id_stream(spark, source, "k string", "k"), store, str(tmp_path / f"check{n}")
        )
    assert sorted(r.id for r in spark.read.parquet(store).collect()) == ["a", "b"]


def test_work_dir_comes_from_the_session(spark):
    assert ingest.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_corpus_job(spark, tmp_path):
    html = (
        '<div class="section" id="s1"><div class="header"><h2>One</h2></div><p>to <a ref-type="sec" anchor="s2">two</a></p>'
        '<div class="figure" id="f1"><div class="img-wrap"><a href="/m.gif"><img alt="é"></a></div>'
        '<div class="figcaption"><b class="title">F</b><p>c</p></div></div></div>'
        '<div class="section" id="s2"><div class="header"><h2>Two</h2></div></div>'
    )
    refs = (
        '<div class="reference-container"><div class="number"><b>1.</b></div><div class="col"><div>Ref</div>'
        '<span class="ref-link"><a href="https://doi.org/10.1/x">CrossRef</a></span></div></div>'
    )
    pages = spark.createDataFrame([(1, "77", html), (2, "unknown", html)], "page_id int, document_id string, html string")
    ref_pages = spark.createDataFrame([(1, refs), (2, refs)], "page_id int, html string")
    papers = spark.createDataFrame(
        [("S1", {"IEEE": "77", "SEMANTIC": "S1"}), ("S2", {"DOI": "10.1/x", "SEMANTIC": "S2"})],
        "semantic_id string, external_ids map<string,string>",
    )
    dois = spark.createDataFrame([], "ieee_id string, doi string")
    answers = spark.createDataFrame([], "doi string, status int, paper_id string")
    made = {}
    for stage in (None, str(tmp_path / "stage")):
        built = corpus.build_corpus(pages, ref_pages, papers, dois, answers, stage=stage)
        assert [r.page_id for r in built.markdown.collect()] == [1]
        assert [r.semantic_id for r in built.references.collect()] == ["S2"]
        records = built.records(output_dir="o", image_dir="i", info_dir="n")
        made[stage] = records.first().record
        if stage:
            K.write_json_records(records, str(tmp_path / "records"))
    assert len(set(made.values())) == 1
    record = json.loads(made[None])
    assert record["output_md_path"] == "o/S1_original.md" and record["relative_img_dir"] == "../img/S1_img"
    assert record["paper_info_path"] == "n/S1_original.json" and record["final_img_dir"] == "i/S1_img"
    assert record["reference_info"] == [
        {"number": "1.", "title": "Ref", "links": {"CrossRef": "https://doi.org/10.1/x"}, "semantic": "S2"}]
    assert [s["title"] for s in record["section_info"]] == ["One", "Two"]
    assert record["img_info"][0]["img_file_name"] == "ieee_77_f1.gif"
    assert "[two](#two)" in record["section_info"][0]["content"]
    assert "é" in (next((tmp_path / "records").glob("*.txt")).read_text(encoding="utf-8") or "é")
