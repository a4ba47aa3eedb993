import json
import random

import pytest
from pyspark.sql import functions as F

from scholarflow.operators import edges as E
from scholarflow.operators import ids as I
from scholarflow.operators import papers as A
from scholarflow.operators import scale as S


@pytest.fixture(scope="module")
def journals(spark):
    return spark.createDataFrame(
        [("Symposium on X", "SX", 0), ("symposium", "SYM", 1), ("100%", "PCT", 2),
         ("symposium", "SY2", 3), ("X", "LATE", 4)],
        "journal string, name_short string, ordinal int",
    )


def raw(spark, *payloads):
    rows = [(f"p{i}", p if p is None or isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "paper_id string, payload string")


def test_normalise(spark, journals):
    answers = raw(
        spark,
        {"title": "T", "authors": [{"name": "A"}, {"name": "B"}], "year": 2020, "venue": "Int. SYMPOSIUM ON x",
         "abstract": r"$\alpha  $", "citationCount": 3, "publicationDate": "2020-02-03",
         "externalIds": {"DOI": "d1", "CorpusId": 7, "IEEE": "stale"}},
        {"title": None, "authors": []},
        {"externalIds": {"DOI": "d2"}, "venue": "The 100% symposium"},
        {}, None, "null", "  { } ",
    )
    resolved = spark.createDataFrame(
        [("d1", "https://ieeexplore.ieee.org/document/55/"), ("d2", "https://dl.acm.org/doi/10.1145/9.9")],
        "doi string, url string",
    )
    rows = {r.semantic_id: r for r in A.normalise_papers(answers, resolved, journals).collect()}
    assert sorted(rows) == ["p0", "p1", "p2"]
    p0 = rows["p0"]
    assert (p0.title, p0.authors, p0.year, p0.venue_short, p0.abstract) == (
        "T", ["A", "B"], 2020, "SX", r"$\alpha$")
    assert str(p0.date) == "2020-02-03"
    assert p0.external_ids == {"DOI": "d1", "CorpusId": "7", "SEMANTIC": "p0", "IEEE": "55", "ACM": None}
    assert rows["p1"].external_ids == {"SEMANTIC": "p1", "IEEE": None, "ACM": None}
    assert rows["p1"].authors == [] and rows["p1"].venue_short is None
    assert rows["p2"].external_ids["ACM"] == "10.1145/9.9"
    assert rows["p2"].venue_short == "SY2"  # first position of the name, last short name

    shown = {r.semantic_id: r for r in A.papers_display(A.normalise_papers(answers, resolved, journals)).collect()}
    assert (shown["p1"].title, shown["p1"].year, shown["p1"].abstract, shown["p1"].venue_short) == (
        "Unknown Title", "Unknown Year", "No abstract available.", "Unknown Venue")


def test_normalise_staged_is_the_same(spark, journals, tmp_path):
    answers = raw(spark, {"title": "T", "venue": "a symposium"}, {"title": "U", "venue": None})
    none = spark.createDataFrame([], "doi string, url string")
    plain = A.normalise_papers(answers, none, journals).drop("external_ids").collect()
    staged = A.normalise_papers(answers, none, journals, stage=str(tmp_path)).drop("external_ids").collect()
    assert sorted(plain) == sorted(staged)


def test_override(spark):
    papers = spark.sql("select 'a' semantic_id, map('IEEE', null, 'DOI', 'd') external_ids, '7' i, '' d")
    row = A.override_ids(papers, IEEE=F.col("i"), DOI=F.col("d")).first()
    assert row.external_ids == {"IEEE": "7", "DOI": "d"}


def test_missing_sets(spark):
    ids = A.clean_ids(spark.createDataFrame([(" a ",), ("",), ("b",), ("b",), ("\t",)], "value string"))
    stored = spark.createDataFrame([("a",)], "semantic_id string")
    assert [r.id for r in A.new_ids(ids, stored).collect()] == ["b"]
    assert sorted(r.id for r in A.new_ids(ids, stored, mode="all").collect()) == ["a", "b", "b"]
    papers = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "paper_id string, n int")
    log = spark.createDataFrame([("y",), ("y",)], "paper_id string")
    missing = A.papers_to_fetch(papers, log)
    assert sorted(r.n for r in missing.collect()) == [1, 2, 4]
    assert A.papers_to_fetch(papers, log, mode="all").count() == 4
    with pytest.raises(ValueError):
        A.papers_to_fetch(papers, log, mode="some")


def test_pending_and_latest(spark):
    papers = spark.sql(
        "select 'a' semantic_id, map('IEEE', '1') external_ids union all "
        "select 'b', map('IEEE', null) union all select 'c', map('IEEE', '3')"
    )
    done = spark.createDataFrame([("c",)], "semantic_id string")
    assert [tuple(r) for r in A.pending_downloads(papers, done).collect()] == [("a", "1")]
    old = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    new = spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert sorted(tuple(r) for r in A.upsert(old, new, ["k"]).collect()) == [(1, "o"), (2, "n"), (3, "n")]
    newer = papers.selectExpr("semantic_id", "map('DOI', semantic_id) as external_ids").where("semantic_id <> 'b'")
    merged = {r.semantic_id: r.external_ids for r in A.upsert(papers, newer, ["semantic_id"]).collect()}
    assert merged == {"a": {"DOI": "a"}, "b": {"IEEE": None}, "c": {"DOI": "c"}}


def test_id_batches_equal_slices(spark, tmp_path):
    """Text ids, a group of nearly all rows, missing keys; rows over several tasks."""
    rows = [(u, f"id{e:03d}") for u, n in (("hot", 295), ("b", 7), (None, 9)) for e in range(n)] + [("b", None)]
    df = spark.createDataFrame(rows, "u string, e string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = A.id_batches(df, within=["u"], order=["e"], size=4, stage=str(tmp_path / "sorted"))
        got = numbered.collect()
        tasks = spark.read.parquet(str(tmp_path / "sorted")).where("u = 'hot'").selectExpr("shiftright(_at, 33)").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 3 and len(got) == len(rows)
    for u in ("hot", "b", None):
        items = sorted((e for v, e in rows if v == u), key=lambda e: (e is not None, e))
        for i in range(0, len(items), 4):
            mine = [r.e for r in got if r.u == u and r.batch_no == i // 4]
            assert sorted(mine, key=lambda e: (e is not None, e)) == items[i:i + 4]


def test_venue_names_equal_a_search(spark):
    """Random names and venues of few letters, so that grams are shared; empty, short and long names."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abA ") for _ in range(n))
    names = [(word(rng.randrange(1, 12)), f"s{i}", i) for i in range(60)] + [("é ü ß longer than any", "s60", 60)]
    venues = [word(rng.randrange(0, 40)) for _ in range(200)] + ["x É Ü ß LONGER than any y", "", "%"]
    df = spark.createDataFrame([(v,) for v in dict.fromkeys(venues)], "venue string")

    def check(names):
        journals = spark.createDataFrame(names, "journal string, name_short string, ordinal int")
        got = {r.venue: r.venue_short for r in A.venue_names(df, journals).collect()}
        first, last = {}, {}
        for j, s, i in names:
            first.setdefault(j, i)
            last[j] = s
        want = {}
        for v in venues:
            found = [(i, last[j]) for j, i in first.items() if j.lower() in v.lower()]
            if found:
                want[v] = min(found)[1]
        assert got == want

    check(names)
    check(names + [("", "any", 61)])
    check([])


def test_venue_rows_grow_with_the_venue_only(spark):
    """Long names of many lengths leave as many rows as the venue has places."""
    journals = spark.createDataFrame([("x" * n + "name", f"s{n}", n) for n in range(1, 80)], "journal string, name_short string, ordinal int")
    venues = spark.createDataFrame([("a" * 100 + "xxxname",)], "venue string")
    seen = A.venue_names(venues, journals)
    assert seen.first().venue_short == "s1"
    plan = seen._jdf.queryExecution().executedPlan()

    def walk(node):
        yield node
        name = node.getClass().getSimpleName()
        below = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        children = node.children()
        for x in below + [children.apply(i) for i in range(children.size())]:
            yield from walk(x)

    seen.collect()
    made = [n.metrics().get("numOutputRows").get().value() for n in walk(plan) if n.getClass().getSimpleName() == "GenerateExec"]
    assert made and max(m for m in made if m) <= 79 * 80  # the names' own grams; the venue has 104


def test_lookup_join_equals_left_join(spark):
    facts = spark.range(200).selectExpr(
        "id", "case when id < 90 then 'hot' when id < 120 then null when id < 140 then 'gone' "
        "else cast(id % 7 as string) end as k"
    )
    dim = spark.createDataFrame([("hot", 1, "x"), ("3", 2, "y"), ("never", 3, "z")], "k string, v int, w string")
    got = S.lookup_join(facts, dim, ["k"], spread=["id"])
    want = facts.join(dim, "k", "left").select("id", "k", "v", "w")
    flat = got.select("id", "k", "hit.v", "hit.w")
    assert sorted(map(repr, flat.collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize("share", ["null", "'hot'"])
def test_lookup_join_spreads_frequent_keys(spark, share):
    """A key that half of all rows have, or their missing key, does not meet in one task."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        facts = spark.range(0, 80_000, 1, 16).selectExpr("id", f"if(id % 2 = 0, {share}, 'k' || id) as k", "sha2(string(id), 512) as pad")
        dim = spark.range(1, 80_000, 2).selectExpr("'k' || id as k", "id as v").union(spark.sql("select 'hot', -1L"))
        got = S.lookup_join(facts, dim, ["k"], spread=["id"])
        counted = got.groupBy(F.spark_partition_id()).agg(F.count("id").alias("n"), F.max(F.length("pad")))
        sizes = [r["n"] for r in counted.collect()]
        assert sum(sizes) == 80_000 and max(sizes) < 2 * 80_000 / 8
        assert got.where("hit.v = -1").count() == (0 if share == "null" else 40_000)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_lookup_join_of_unlike_types(spark):
    facts = spark.range(5).selectExpr("id", "cast(id as int) as k")
    dim = spark.range(3).selectExpr("id as k", "id * 10 as v")
    got = S.lookup_join(facts, dim, ["k"], spread=["id"])
    assert sorted((r.id, r.hit and r.hit.v) for r in got.collect()) == [(0, 0), (1, 10), (2, 20), (3, None), (4, None)]


def test_anti_lookup_with_hot_keys(spark):
    facts = spark.range(100).selectExpr("id", "if(id < 60, 1, id) as k")
    present = spark.range(1, 80, 2).selectExpr("id as k")
    got = S.anti_lookup(facts, present, ["k"], spread=["id"])
    want = facts.join(present, "k", "left_anti")
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


@pytest.fixture(scope="module")
def papers(spark):
    return spark.createDataFrame(
        [("s2", {"DOI": "d", "IEEE": "1", "SEMANTIC": "s2"}), ("s1", {"DOI": "d", "IEEE": None, "SEMANTIC": "s1"}),
         ("s3", {"IEEE": "8686088", "SEMANTIC": "d3b8b9e6b3"}), ("s4", {"IEEE": "4", "SEMANTIC": ""})],
        "semantic_id string, external_ids map<string,string>",
    )


def ask(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_lookup(spark, papers):
    found = I.lookup_ids(ask(spark, "8686088", "none", "4", None), papers, "IEEE", "SEMANTIC").collect()
    assert {r.value: r.result for r in found} == {"8686088": "d3b8b9e6b3", "none": None, "4": None, None: None}
    # the first record decides even though its wanted id is NULL there
    first = I.lookup_ids(ask(spark, "d"), papers, "DOI", "IEEE").first()
    assert first.result is None


def test_cascade(spark, papers):
    answers = spark.createDataFrame(
        [("d", 200, "other"), ("e", 200, "new"), ("f", 404, "no")], "doi string, status int, paper_id string"
    )
    asked = spark.createDataFrame([("d",), ("e",), ("f",), (None,)], "doi string")
    got = {r.doi: (r.semantic_id, r.is_new) for r in I.semantic_from_doi(asked, papers, answers).collect()}
    assert got == {"d": ("s1", False), "e": ("new", True), "f": (None, False), None: (None, False)}
    dois = spark.createDataFrame([("1", "e"), ("5", "d"), ("6", "e"), ("7", "f")], "ieee_id string, doi string")
    asked = spark.createDataFrame([("1",), ("5",), ("6",), ("7",), ("9",)], "ieee_id string")
    got = {r.ieee_id: (r.semantic_id, r.is_new) for r in I.semantic_from_ieee(
        asked, I.semantic_index_of_ieee(papers, dois, answers)).collect()}
    assert got == {"1": ("s2", False), "5": ("s1", False), "6": ("new", True), "7": (None, False), "9": (None, False)}


def test_edges(spark):
    rows = [
        ("p", "reference", json.dumps({"data": [
            {"intents": ["background"], "isInfluential": True,
             "citedPaper": {"paperId": "x", "title": "X", "year": 2020, "venue": "V"}},
            {"citedPaper": {"paperId": "y"}}]})),
        ("q", "citation", json.dumps([{"citingPaper": {"paperId": "z"}}, {"paperId": "flat", "year": 1}])),
        ("r", "citation", '{"data": []}'), ("s", "citation", "{}"),
    ]
    raw_edges = spark.createDataFrame(rows, "paper_id string, direction string, payload string")
    got = E.flatten_edges(raw_edges).orderBy("paper_id", "ordinal").collect()
    assert [(r.paper_id, r.other_id, r.year, r.is_influential, r.ordinal) for r in got] == [
        ("p", "x", 2020, True, 0), ("p", "y", None, None, 1), ("q", "z", None, None, 0), ("q", "flat", 1, None, 1)]
    stored = spark.createDataFrame([("x",)], "semantic_id string")
    top = E.frontier(E.flatten_edges(raw_edges), stored, 2).collect()
    assert [(r.other_id, r.n_edges) for r in top] == [("flat", 1), ("y", 1)]
    assert [r.other_id for r in E.frontier(E.flatten_edges(raw_edges), stored, 5, paper_id="p").collect()] == ["y"]
