"""Both removers of repeats against brute force, also with every group split."""

import hashlib
import random
from collections import defaultdict

import pytest

from scholarflow.llm import repeats, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, doc int, spans string"


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    passage = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 60))) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(passage) if rng.random() < 0.6 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))
                 for _ in range(rng.randint(0, 5))]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    texts += [texts[3], texts[3], None, "", "a" * 400, "x " * 150, "  \t ", "x " * 60]
    rows = [(i, t, 0, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[5], 1, "s"), (7, texts[9], 1, "s")]
    rng.shuffle(rows)
    return rows


def by_bytes(rows, window, keep):
    raw = [(t or "").encode() for _, t, _, _ in rows]
    places = defaultdict(list)
    for d, b in enumerate(raw):
        for p in range(len(b) - window + 1):
            places[b[p : p + window]].append((d, p))
    out = []
    for d, b in enumerate(raw):
        gone = [False] * len(b)
        for p in range(len(b) - window + 1):
            if len(places[b[p : p + window]]) > 1:
                gone[p : p + window] = [True] * window
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(rows[d][0]), len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def by_words(rows, window):
    import re

    docs = [(float("inf") if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in rows]
    least = {}
    for d, ws in docs:
        for p in range(len(ws) - window + 1):
            x = tuple(ws[p : p + window])
            least[x] = min(least.get(x, d), d)
    out = []
    for (d, ws), (i, *_rest) in zip(docs, rows):
        gone = set()
        for p in range(len(ws) - window + 1):
            if least[tuple(ws[p : p + window])] < d:
                gone.update(range(p, p + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((str(i), len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [64, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_bytes(spark, seed, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = suffix_dedup.remove_repeats(docs, window=40, gram=10, keep="none").collect()
    mine = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in found)
    assert mine == by_bytes(rows, 40, "none")


@pytest.mark.parametrize("most", [64, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = substring_dedup.drop_repeats(docs, window=12, gram=4).collect()
    mine = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in found)
    assert mine == by_words(rows, 12)


@pytest.mark.parametrize("most", [64, 1])
def test_bytes_keep_first(spark, most, monkeypatch):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    rows = [r for i, r in enumerate(sorted(corpus(3), key=str)) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # one row per id, so that order is plain
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r["doc_id"]: r["kept"] for r in suffix_dedup.remove_repeats(docs, window=40, gram=10, keep="first").collect()}
    seen = set()
    for i, t, _, _ in sorted(rows):
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - 39):
            if raw[p : p + 40] in seen:
                gone[p : p + 40] = [True] * 40
            seen.add(raw[p : p + 40])
        assert found[i] == bytes(c for c, g in zip(raw, gone) if not g)


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.remove_repeats(none).collect() == []
    assert substring_dedup.drop_repeats(none).collect() == []
