"""Packing and fingerprints against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholarflow.llm import fingerprints, packing
from scholarflow.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, tie string, run int"
TEXTS = [
    (5, "The cat's sat.", "x", 1), (3, None, None, None), (9, "", "a", 2), (9, "", "a", 2),
    (2, "one two  three\n\nfour" * 40, "b", 3), (7, "Ünïcode, naïve… café! é  wide <|endoftext|> x", "c", 4),
    (1, "alpha beta " * 9000, "d", 5), (None, "no id", "e", 6), (4, "one two three four five", "f", 7),
]


def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(TEXTS, SCHEMA)
    rows = packing.pack(docs, vocabulary()).collect()
    tokenizer = Tokenizer.from_file(vocabulary())
    expected = []
    for doc_id, text, _, _ in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            expected.append((doc_id, piece, start, len(part), zlib.crc32(part.tobytes())))
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in rows), key=order) == sorted(expected, key=order)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_all_items(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 300))
    counts = {int(n): int(rng.integers(0, 50)) for n in rng.integers(1, capacity + 1, 60)}
    groups = packing.match_and_fit(counts, capacity)
    held = defaultdict(int)
    for g in groups:
        assert sum(g.lengths) == capacity - g.gap <= capacity
        assert sum(3 * n > capacity for n in g.lengths) <= 2
        for n in g.lengths:
            held[n] += g.count
    assert dict(held) == {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    assert sum(g.count for g in groups) <= 1.5 * -(-total // capacity) + 2


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none, vocabulary()).collect() == []
    assert fingerprints.with_edits(none).collect() == []


@pytest.mark.parametrize("per_run", [1, 2, 100])
def test_next_document(spark, per_run, monkeypatch):
    monkeypatch.setattr(fingerprints.in_runs, "__defaults__", (per_run, 20_000))
    rows = fingerprints.with_edits(spark.createDataFrame(TEXTS, SCHEMA).repartition(3)).collect()
    ties = {r["text"]: r["h"] for r in spark.createDataFrame(TEXTS, SCHEMA)
            .select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    given = sorted(((i, t or "") for i, t, _, _ in TEXTS), key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    expected = []
    for k, (doc_id, text) in enumerate(given):
        new = fingerprints.edited(text, given[(k + 1) % len(given)][1])
        expected.append((str(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(expected)
    by_text = {}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert by_text[9] == by_text[3]


def test_digest_by_hand():
    texts = [b"", b"ab", b"abcdefgh", b"hello world, hello there" * 5, bytes(range(256))]
    data = np.frombuffer(b"".join(texts), np.uint8)
    found = fingerprints.digests(data, np.cumsum([0, *map(len, texts)]))
    for text, row in zip(texts, found):
        counts = [0] * 128
        for p in range(len(text)):
            for k, (_, j, last) in enumerate(fingerprints.TRIPLETS):
                if p + last < len(text):
                    h = int(fingerprints._FIRST[text[p]] ^ fingerprints._SECOND[text[p + j]] ^ fingerprints._THIRD[text[p + last]])
                    counts[(h * (2 * k + 0x9E3779B1)) % 2**32 >> 25] += 1
        q = [sorted(counts)[i] for i in (31, 63, 95)]
        level = [sum(c > x for x in q) for c in counts]
        body = bytes(sum(level[4 * i + k] << 2 * k for k in range(4)) for i in range(32))
        assert row.tobytes()[3:] == body
    assert (fingerprints.difference(found, found) == 0).all()
