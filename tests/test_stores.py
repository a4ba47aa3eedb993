"""Bucketed upserts, stored indexes, the fetch log and stateful latest writes."""

import datetime as dt
import os

import pytest

from scholarflow.operators import papers as A
from scholarflow.sources import sinks as K
from scholarflow.sources.stores import BucketStore, FetchLog, IdIndex
from scholarflow.streaming import ingest

SCHEMA = "id string, at int, value string"


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def stored(store):
    return {r["id"]: (r["at"], r["value"]) for r in store.read().collect()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "papers"), ("id",), 16, ("at",))
    assert store.read() is None
    first = spark.createDataFrame([(f"p{i}", 1, "old") for i in range(400)], SCHEMA)
    assert store.upsert(first, stage=str(tmp_path / "s1")) == 16
    before = files(store.path)
    new = spark.createDataFrame([("p7", 2, "new"), ("p7", 1, "between"), ("p8", 0, "late")], SCHEMA)
    touched = store.upsert(new, stage=str(tmp_path / "s2"))
    after = files(store.path)
    assert touched <= 2 and len(before - after) == len(after - before) == touched
    want = {f"p{i}": (1, "old") for i in range(400)} | {"p7": (2, "new")}
    assert stored(store) == want
    # the same write again changes no row
    store.upsert(new, stage=str(tmp_path / "s3"))
    assert stored(store) == want and store.read().count() == 400
    assert [r["value"] for r in store.find(new.select("id").where("id = 'p7'")).collect()] == ["new"]
    with pytest.raises(ValueError, match="16 buckets"):
        BucketStore(spark, store.path, ("id",), 8).read()
    assert store.upsert(new.limit(0), stage=str(tmp_path / "s4")) == 0


def test_upsert_without_times_takes_the_last_write(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "t"), ("id",), 4)
    for n, value in enumerate(("a", "b")):
        store.upsert(spark.createDataFrame([("x", 5 - n, value), (None, 1, value)], SCHEMA), stage=str(tmp_path / f"s{n}"))
    assert stored(store) == {"x": (4, "b"), None: (1, "b")}


def test_stored_index_is_not_shuffled(spark, tmp_path):
    pairs = spark.createDataFrame([(f"v{i}", f"r{i}") for i in range(1000)], "value string, result string")
    index = IdIndex.write(pairs, "ids_a", str(tmp_path / "ids"), buckets=8)
    asked = spark.createDataFrame([(i, f"v{i}" if i % 3 else None) for i in range(50)] + [(99, "none")], "n int, id string")
    found = index.lookup(asked, "id", "own")
    assert {r["n"]: r["own"] for r in found.collect()} == {i: f"r{i}" if i % 3 else None for i in range(50)} | {99: None}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange") == 1
    again = IdIndex.open(spark, "ids_b", str(tmp_path / "ids"), schema="value string, result string", buckets=8)
    few = again.find(["v3"])
    assert [r["result"] for r in few.collect()] == ["r3"]
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # for the plan to show the buckets
    try:
        plan = again.find(["v3"])._jdf.queryExecution().executedPlan()
        assert "SelectedBucketsCount" in plan.collectLeaves().head().metadata().keySet().toString()
        assert plan.collectLeaves().head().metadata().get("SelectedBucketsCount").get().startswith("1 out of 8")
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.sql("drop table ids_a")
    spark.sql("drop table ids_b")


def test_a_paper_with_an_empty_list_is_not_asked_again(spark, tmp_path):
    log = FetchLog(spark, str(tmp_path / "log"))
    papers = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    assert {r[0] for r in A.papers_to_fetch(papers, log.asked("reference")).collect()} == {"a", "b", "c"}
    raw = spark.createDataFrame(
        [("a", "reference", '{"data": []}'), ("b", "reference", '{"data": [{"citedPaper": {"paperId": "x"}}]}'), ("c", "citation", "{}")],
        "paper_id string, direction string, payload string",
    )
    for _ in range(2):  # a repeated run is logged once
        K.write_fetched(raw, str(tmp_path / "edges"), log, run="1", fetched_at="2024-01-01")
    assert {r[0] for r in A.papers_to_fetch(papers, log.asked("reference")).collect()} == {"c"}
    assert sorted((r["paper_id"], r["n_edges"]) for r in log.read().collect()) == [("a", 0), ("b", 1), ("c", 0)]
    assert spark.read.parquet(str(tmp_path / "edges")).select("other_id").collect()[0][0] == "x"


def test_newer_records_replace_across_runs(spark, tmp_path):
    schema = "id string, at timestamp, value string"
    store = BucketStore(spark, str(tmp_path / "store"), ("id",), 4, ("at",))
    source, day = str(tmp_path / "in"), lambda n: dt.datetime(2024, 1, n)
    runs = [
        [("a", day(2), "first"), ("b", day(5), "b5"), ("b", day(4), "b4"), (None, day(9), "x"), ("c", None, "x")],
        [("a", day(3), "second"), ("b", day(1), "late")],
        [("a", day(1), "late"), ("c", day(1), "c1")],
    ]
    wants = [{"a": "first", "b": "b5"}, {"a": "second", "b": "b5"}, {"a": "second", "b": "b5", "c": "c1"}]
    for n, (rows, want) in enumerate(zip(runs, wants)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.ingest_latest(stream, store, str(tmp_path / "check"), stage=str(tmp_path / f"stage{n}"))
        assert {r["id"]: r["value"] for r in store.read().collect()} == want
