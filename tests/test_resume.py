"""Transforms that are stopped and go on, and the alignment of headings."""

import collections
import glob
import os
import random

import pytest

from scholarflow.operators import chunks as C


def asked(folder):
    """How often each text was asked for, from the files the calls left."""
    n = collections.Counter()
    for path in glob.glob(f"{folder}/*"):
        with open(path) as f:
            n[f.read()] += 1
    return n


def client(folder, stop_at):
    """A callable that notes each call, and dies at one text."""
    def make():
        def apply(text):
            with open(f"{folder}/{os.getpid()}-{random.random()}", "w") as f:
                f.write(text)
            if text == stop_at:
                raise SystemExit("killed")
            if text.startswith("bad"):
                raise ValueError("no answer")
            return text.upper()
        return apply
    return make


def test_a_killed_run_goes_on(spark, tmp_path):
    rows = [(d, 0, 1, "head") for d in range(5)] + [(d, 1, p, f"text {p % 30}") for d in range(5) for p in range(40)]
    rows += [(9, 1, 1, " \n"), (9, 1, 2, "bad one"), (9, 1, 3, "")]
    chunks = spark.createDataFrame(rows, "doc_id int, chapter_no int, part_no int, text string").repartition(3)
    store, calls = C.AnswerStore(spark, str(tmp_path / "answers"), "upper"), str(tmp_path / "calls")
    os.mkdir(calls)
    run = lambda stop: C.transform_resumable(
        chunks, client(calls, stop), store, min_length=1, attempts=1, tasks=2, waves=6
    )
    with pytest.raises(Exception, match="killed|SystemExit|crashed|exit"):
        run("text 11")
    done = {r["chunk"] for r in store.read().where("output is not null").collect()}
    keys = {f"text {p}": spark.range(1).selectExpr(f"'text {p}' as t").select(store.key("t")).first()[0] for p in range(30)}
    first = asked(calls)
    assert 0 < len(done) < 30 and max(first.values()) == 1
    result = {(r["doc_id"], r["chapter_no"], r["part_no"]): r for r in run(None).collect()}
    both = asked(calls)
    assert all(both[t] == 1 for t, k in keys.items() if k in done)  # stored answers are not asked again
    assert all(1 <= both[f"text {p}"] <= 2 for p in range(30))
    assert len(result) == len(rows)
    for d, c, p, text in rows:
        r = result[d, c, p]
        if text == "bad one":
            assert r["output"] is None and r["status"] == "error" and "no answer" in r["error"]
        elif c == 0 or not text.strip():
            assert (r["output"], r["status"], r["tries"]) == (text, "blank", 0)
        else:
            assert (r["output"], r["status"], r["error"]) == (text.upper(), "ok", None)
    # a further run asks for the failed chunk only; another instruction for everything
    run(None)
    again = asked(calls)
    assert {t: n - both[t] for t, n in again.items() if n > both[t]} == {"bad one": 1}
    other = C.AnswerStore(spark, store.path, "louder")
    C.transform_resumable(chunks, client(calls, None), other, min_length=1, attempts=1, waves=1)
    assert asked(calls)["text 3"] == again["text 3"] + 1


def test_resuming_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id int, text string")
    store = C.AnswerStore(spark, str(tmp_path / "a"), "x")
    assert C.transform_resumable(none, lambda: str.upper, store, waves=1).collect() == []


def longest(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_common_sequence_is_longest():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        found = C.common_sequence(a, b)
        assert len(found) == longest(a, b) and all(a[i] == b[j] for i, j in found)
        assert all(x < y and u < v for (x, u), (y, v) in zip(found, found[1:]))


def test_headings_are_aligned(spark):
    text = lambda *names: "# t\n\n" + "".join(f"## {n}\n\nbody\n\n" for n in names)
    schema = "doc_id int, markdown string"
    source = spark.createDataFrame([(1, text("a", "b", "c", "d")), (2, text("x", "x")), (3, text("only")), (4, None), (5, "")], schema)
    output = spark.createDataFrame([(1, text("a", "c", "b", "e")), (2, text("x", "y", "x", "x")), (5, text("z")), (6, text("q"))], schema)
    got = {(r["doc_id"], r["status"], r["heading"], r["source_no"], r["output_no"]) for r in C.align_headings(source, output).collect()}
    one = {r[1:3] for r in got if r[0] == 1}
    assert one in ({("kept", "a"), ("kept", "c"), ("moved", "b"), ("missing", "d"), ("extra", "e")},
                   {("kept", "a"), ("kept", "b"), ("moved", "c"), ("missing", "d"), ("extra", "e")})
    assert sorted(r[1:3] for r in got if r[0] == 2) == [("extra", "x"), ("extra", "y"), ("kept", "x"), ("kept", "x")]
    assert (3, "missing", "only", 0, None) in got and (5, "extra", "z", None, 0) in got and {r[0] for r in got} == {1, 2, 3, 5}
