"""Edge cases and brute-force twins of the other operators, and the pipeline."""

import json
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from scholarflow.llm import (
    decontaminate, language_id, line_dedup, lm_scoring, minhash, packing, queries, toxicity,
)
from scholarflow.llm.components import components
from tools import check

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, row int, kept string, host int"
ODD = [
    (1, None, None, None, None, None, None, None, None), (2, "", "en", "s", 0, "t", 1, "k", 2),
    (3, " \n\t ", None, "s", 3, None, 1, None, 2), (4, "12 34 !!", "en", None, 8, "t", 1, "k", 2),
    (5, "The end of the line.\nNext é", "en", "s", 9, "t", 1, "k", 2), (5, "The end of the line.\nNext é", "en", "s", 9, "t", 1, "k", 2),
    (None, "no id at all", "fr", "s", 9, "t", 1, "k", 2), (7, "x" * 70_000 + " y" * 70_000, "en", "s", 9, "t", 1, "k", 2),
    (8, "THE END of the\tline. next é", "en", "s", 9, "t", 1, "k", 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def con():
    return check.database(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, name, SF)
    assert ok, note


def test_every_operator_has_a_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))


# line dedup


def test_lines(spark, odd, empty):
    rows = [(i, f"menu\nown {i}\n\nfoot" if i % 2 else f"own {i}\nmenu\nmenu", "a") for i in range(20)]
    rows += [(100 + i, f"menu\nx{i}", None) for i in range(4)] + [(200, "menu", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(docs, max_ratio=0.6, min_pages=3).collect()}
    assert out[1]["text"] == "own 1\n\nfoot" and out[1]["n_removed"] == 1
    assert out[2]["text"] == "own 2" and out[2]["n_removed"] == 2 and out[2]["n_lines"] == 3
    assert out[100]["text"] == "x0" and out[200]["text"] == "menu"
    got = line_dedup.line_dedup(odd, max_ratio=0.1, min_pages=2).collect()
    assert sorted(c for c in got[0].asDict()) == sorted([*odd.columns, "n_lines", "n_removed"]) and len(got) == len(ODD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["text"] is None and by_id[1]["n_lines"] == 0 and by_id[2]["n_lines"] == 1
    assert by_id[5]["n_removed"] == 2  # two pages of six hold its lines
    assert line_dedup.line_dedup(empty).collect() == []


# language identification


def plain_code_length(texts, text, symbols):
    """Prediction by partial matching, byte by byte, without tables."""
    counts = {}
    for t in texts:
        for i in range(len(t)):
            for order in range(4):
                context = tuple(t[i - k] if i - k >= 0 else None for k in range(1, order + 1))
                counts.setdefault(context, {}).setdefault(t[i], 0)
                counts[context][t[i]] += 1
    bits = 0.0
    for i, b in enumerate(text):
        for order in range(3, -2, -1):
            if order < 0:
                bits += 8
                break
            context = tuple((text[i - k] if text[i - k] in symbols else -1) if i - k >= 0 else None for k in range(1, order + 1))
            seen = counts.get(context)
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if b in seen:
                bits += np.log2(total / seen[b])
                break
            bits += np.log2(total / len(seen))
    return bits


def test_code_lengths():
    texts = {"a": [b"abracadabra", b"cab"], "b": [b"hello hello", b"", "olé".encode()]}
    model = language_id.train(texts)
    symbols = set(b"".join(b"".join(t) for t in texts.values()))
    tried = [b"abra", b"", b"hello cab", b"zzz\xff", b"lo"]
    found = language_id.code_lengths(model, np.frombuffer(b"".join(tried), np.uint8), np.cumsum([0, *map(len, tried)]))
    for text, row in zip(tried, found):
        for lang, bits in zip(model.languages, row):
            assert bits == pytest.approx(plain_code_length(texts[lang], text, symbols), rel=1e-4, abs=1e-4)


def test_languages(spark, odd, empty):
    rows = language_id.language_id(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = {o[0]: o[1] for o in ODD}[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    assert language_id.language_id(empty).collect() == []


def test_languages_in_bounded_runs():
    """A large batch is scored, and given back, in runs; what a worker holds does not grow with it."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "cab", "hello", "olé"]) for _ in range(4000)) for _ in range(200)] + [None, "", "12"]
    model = language_id.train({"a": [b"abracadabra", b"cab"], "b": [b"hello hello", "olé".encode()]})
    letters = [bool(t) and t != "12" for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(letters), pa.array(texts)], names=["row", "letters", "text"])
    encoded = [(t or "").encode() for t in texts]
    bits = np.concatenate([language_id.code_lengths(model, np.frombuffer(e, np.uint8), np.array([0, len(e)])) for e in encoded])
    tracemalloc.start()
    parts = list(language_id.scored(model, batch, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 4 and peak < 50 << 20  # by runs of 2 MB of text: 96 MB
    got = pa.Table.from_batches(parts).to_pydict()
    assert got["row"] == list(range(len(texts))) and got["text"] == texts
    assert got["lang_pred"] == [model.languages[b.argmin()] if ok else "und" for b, ok in zip(bits, letters)]
    assert all((p > 0) == ok for p, ok in zip(got["score"], letters))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97


# near duplicates


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("block", [1000, 3])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for group in range(6):
        words = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(12):  # a drifting chain: ends are far apart, neighbours are near
            words = list(words)
            words[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words).upper() if rng.random() < 0.2 else "\n".join(words)))
    rows += [(900, "a b"), (901, "A  b"), (902, "a b c"), (903, None), (904, ""), (905, "  "), (906, rows[0][1]), (907, rows[0][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = minhash.near_duplicates(docs, shingle=4, percent=80).collect()
    expected = brute_components(rows, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_odd(spark, odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(ODD)
    assert found[8]["component_id"] == 5 and not found[8]["kept"]
    assert found[None]["component_id"] is None and found[None]["kept"]
    assert found[1]["component_id"] == 1 and found[1]["n_shingles"] == 0
    assert minhash.near_duplicates(empty).collect() == []
    kept = minhash.first_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    conflict = spark.createDataFrame([(4, "a b c d e f"), (4, "p q r s t u"), (6, "p q r s t u"), (3, "a b c d e f")], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(conflict).collect()} == {3}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 240), rng.randrange(200, 240)) for _ in range(30)]
    label = {n: n for e in links for n in e if e[0] != e[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == label


# decontamination


def test_contaminations(spark, odd, empty):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(80)]
    item = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(0, item(20)), (1, item(20)), (2, item(33)), (3, "two words"), (4, None), (5, ""), (6, item(33)), (7, "z z z z z z z z z"), (None, item(12))]
    docs = []
    for i in range(40):
        held = rng.choice(items)[1] or ""
        words = held.split()
        if words and rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        docs.append((i, "\n".join([item(rng.randrange(30)), " ".join(words).title(), item(rng.randrange(30))])))
    docs += [(50, None), (50, ""), (51, "z " * 30), (52, "z z"), (52, "z z"), (None, items[0][1])]
    found = decontaminate.contaminations(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
    ).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    expected = set()
    for d, text in docs:
        ws = words(text)
        for i, body in items:
            it = words(body)
            m, k = len(it), min(5, len(it))
            if m == 0:
                continue
            grams = [tuple(it[j : j + k]) for j in range(m - k + 1)]
            reached = []
            for s in range(len(ws) - m + 1):
                win = [tuple(ws[j : j + k]) for j in range(s, s + m - k + 1)]
                common = sum(min(win.count(g), grams.count(g)) for g in set(grams))
                if 100 * common >= 80 * (2 * len(grams) - common):
                    reached.append((-common / (2 * len(grams) - common), s))
            if reached:
                expected.add((str(d), str(i), round(-min(reached)[0], 9), len(reached), min(reached)[1], m))
    mine = [(str(r["doc_id"]), str(r["item_id"]), round(r["similarity"], 9), r["n_windows"], r["start"], r["n_words"]) for r in found]
    assert sorted(mine) == sorted(expected)
    benchmark = spark.createDataFrame([(1, "the end of the line. next é")], "item_id int, text string")
    clean = decontaminate.decontaminate(odd, benchmark)
    assert clean.columns == odd.columns and clean.where("doc_id in (5, 8)").count() == 0 and clean.count() == len(ODD) - 3
    assert decontaminate.decontaminate(empty, benchmark).collect() == []
    assert decontaminate.decontaminate(odd, benchmark.where("false")).count() == len(ODD)


# models


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    texts = [b"you are an idiot and a fool today my friend", b"nice words only here in this text", b"", b"trash talk"]
    t = toxicity.read(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    every = np.arange(len(t.hashes))
    net = toxicity.Network(t.hashes, np.unique(t.grams(every)[0]))
    net.start(rng)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    place, _ = toxicity.windows(t.first)
    rows, x = np.where(place >= 0, t.word[place], -1), net.inputs(t, every)
    y, w = np.array([1, 0, 0, 1.0]), np.array([1, 2, 1, 1.0])
    gradients = net.gradients(x, rows, y, w)[1]
    for k, g in gradients.items():
        for _ in range(4):
            i = tuple(rng.integers(1, s) if s > 1 else 0 for s in g.shape)
            old, step = net.p[k][i], 1e-3
            net.p[k][i] = old + step
            up = net.gradients(x, rows, y, w)[0]
            net.p[k][i] = old - step
            down = net.gradients(x, rows, y, w)[0]
            net.p[k][i] = old
            assert g[i] == pytest.approx((up - down) / 2 / step, rel=0.05, abs=3e-4)


def test_toxicity(spark, odd, empty):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "moron", "scumbag"])
        rows.append((i, " ".join(words)))
        if i < 700:
            labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 200 and np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in found)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(odd, none).collect()} == {0.0}
    some = spark.createDataFrame([(2, 1, 0), (5, 0, 1), (5, 0, None), (None, 1, 1), (4, 1, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    assert len(toxicity.toxicity(odd, some).collect()) == len(ODD)
    assert toxicity.toxicity(empty, some).collect() == []


def test_language_model(spark, odd, empty):
    rng = np.random.default_rng(0)
    net = lm_scoring.Network(lm_scoring.Network.initial())
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    token = rng.integers(0, lm_scoring.CLASSES, 50)
    around = lm_scoring.contexts(token, np.array([0, 10, 10, 50]))
    assert around[0].tolist() == [lm_scoring.BORDER] * 2 + token[1:3].tolist()
    assert around[9].tolist() == token[7:9].tolist() + [lm_scoring.BORDER] * 2
    for k, g in net.gradients(around, token)[1].items():
        i = tuple(rng.integers(0, s) for s in g.shape)
        old = net.p[k][i]
        net.p[k][i] = old + 1e-5
        up = net.gradients(around, token)[0]
        net.p[k][i] = old - 1e-5
        down = net.gradients(around, token)[0]
        net.p[k][i] = old
        assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)
    ordered = [(i, "a b c d e f g h " * 30) for i in range(60)]
    shuffled = [(100 + i, " ".join(rng.permutation(list("abcdefgh" * 30)))) for i in range(5)]
    found = {r["doc_id"]: r for r in lm_scoring.lm_scores(spark.createDataFrame(ordered + shuffled, "doc_id long, text string")).collect()}
    assert found[0]["n_tokens"] == 240
    assert min(found[i]["per_token"] for i in range(60)) > max(found[100 + i]["per_token"] for i in range(5)) + 0.5
    rows = {r["doc_id"]: r for r in lm_scoring.lm_scores(odd).collect()}
    assert rows[1]["n_tokens"] == rows[3]["n_tokens"] == 0 and rows[1]["log_likelihood"] == 0.0
    assert rows[5]["log_likelihood"] < 0 and len(rows) == len(ODD) - 1
    assert lm_scoring.lm_scores(empty).collect() == []


def test_word_counts(spark):
    docs = spark.createDataFrame([(1, "a A b"), (2, "b\tb"), (3, None)], "doc_id long, text string").repartition(3)
    assert sorted(r["n"] for r in lm_scoring.counts(docs).collect()) == [2, 3]


def test_probabilities_of_all_words_sum_to_one(spark):
    """One-word texts share their (empty) context, and the corpus has no other words."""
    rows = [(10 * i + k, f"w{i}") for i in range(3000) for k in range(1 + (i % 7 == 0) + 6 * (i % 100 == 0))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["log_likelihood"] for r in lm_scoring.lm_scores(docs).collect()}
    assert len(found) == len(rows)
    assert sum(np.exp(found[10 * i]) for i in range(3000)) == pytest.approx(1, abs=1e-3)


# the pipeline


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF)
        kept = out.collect()
        if name == "language_id":
            letters = {r["doc_id"] for r in before if r["text"] and any(c.isalpha() for c in r["text"])}
            assert {r["doc_id"] for r in kept} == letters and all(r["lang"] != "und" for r in kept)
        if name == "line_dedup":
            pages = {}
            for r in before:
                pages.setdefault(r["source"], []).append(r)
            expected = {}
            for rows in pages.values():
                lines = [set(r["text"].split("\n")) for r in rows]
                for r in rows:
                    keep = [x for x in r["text"].split("\n")
                            if not x.strip(" ") or not ((n := sum(x in s for s in lines)) >= 5 and n > 0.05 * len(rows))]
                    if any(x.strip(" ") for x in keep) or "\n".join(keep) == r["text"]:
                        expected[r["doc_id"]] = "\n".join(keep)
            assert {r["doc_id"]: r["text"] for r in kept} == expected
        if name == "near_dedup":
            groups = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert {r["doc_id"] for r in kept} == {i for i, (_, c) in groups.items() if i == c}
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.contaminations(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert bad and {r["doc_id"] for r in kept} == {r["doc_id"] for r in before} - bad
        if name == "packing":
            assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in before}
            used = {}
            for r in kept:
                used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
            assert max(used.values()) <= packing.CAPACITY
        else:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in kept)
            docs = spark.createDataFrame(kept, docs.schema) if kept else docs.limit(0)
    last = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, last.select("doc_id", "piece", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept)


def test_pipeline_on_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        assert rows.count() >= 0


def test_pipeline_keeps_one_of_each_group_of_copies(spark):
    """Groups of copies above 5 % of a source: exact ones, of one line and of several, and near ones without a line of their own."""
    words = lambda n, seed: " ".join(random.Random(f"{n} {seed}").sample([f"w{i}" for i in range(900)], 30))
    rows = [(i, f"menu of the site\n{words(i, 'own')}\n{words(i, 'more')}") for i in range(60)]
    rows += [(100 + i, words(0, "single")) for i in range(12)]
    rows += [(200 + i, f"{words(0, 'first')}\n{words(0, 'second')}\n\n{words(0, 'third')}") for i in range(12)]
    near = [words(k, "near") for k in range(12)]
    rows += [(300 + i, "\n".join(near[i:] + near[:i])) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    cleaned = corpus_pipeline.drop_boilerplate(spark, docs, SF)
    texts, given = {r["doc_id"]: r["text"] for r in cleaned.collect()}, dict(rows)
    assert all(texts[i] == given[i].split("\n", 1)[1] for i in range(60))
    assert all(texts[i] == given[i] for i in given if i >= 100)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, cleaned, SF).collect()}
    assert kept == {*range(60), 100, 200, 300}


def test_rest_works_without_this_package():
    code = (
        "import sys, json\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('scholarflow.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(json.dumps(sorted(e.queries())))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    names = json.loads(out)
    assert names and not any(n.startswith("op") or n == "pipeline" for n in names)
