"""Source divergence, embedding links and chat log repair against plain versions."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from scholarflow.llm import conversation_repair as repair
from scholarflow.llm import embedding_join, source_audit

# chat logs

LOGS = "conv_id long, turn long, role string, text string, digest string, n int, audit int, code string"
FOLLOW = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """Every column of a conversation's rows after damage, by a table over all prefixes."""
    rows = sorted(
        ((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).digest()),
    )
    seen, faults = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))

    def put(best, state, value):
        if state not in best or value[:2] < best[state][:2]:
            best[state] = value

    def insert(best):
        for _ in range(3):
            for state, (cost, audit, lines) in list(best.items()):
                for x, name in (("u", "user"), ("a", "assistant")):
                    if x in FOLLOW[state]:
                        put(best, x, (cost + 3, audit + "I", (*lines, f"{name}:")))
        return best

    best = insert({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in best.items():
            put(after, state, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault else 0
            if role[:1] and role[0] in FOLLOW[state]:
                put(after, role[0], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for x, name in (("u", "user"), ("a", "assistant")):
                if x in FOLLOW[state]:
                    put(after, x, (cost + extra + 3, audit + "R", (*lines, f"{name}:{text}")))
        best = insert(after)
    cost, audit, lines = min(best[s] for s in ("", "a") if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    n = collections.Counter(faults)
    return {
        "n_rows": len(rows), "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": n["blank"],
        "duplicate": n["duplicate"], "truncated": n["truncated"],
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "cost": cost, "audit": audit,
        "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def logs(seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ultra"], ["Hi.", "Hi", " \t", "", None, "What?\n ", "é! ", "no. no"]
    rows = []
    for conv in [None, *range(12)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((conv, None if rng.random() < 0.1 else t + rng.randrange(2), rng.choice(roles), rng.choice(texts)))
    for t in range(900):  # a conversation far longer than a stretch, over several tasks
        rows.append((50, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"{rng.randrange(600)}" + rng.choice([".", ""])))
    rows += rng.sample(rows, 40)  # repeated rows
    return rows


def check_repairs(spark, rows):
    docs = spark.createDataFrame([(*r, "d", 1, 2, "c") for r in rows], LOGS).repartition(4)
    found = repair.repairs(docs).cache()
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(repair.repaired_rows(docs, found)).collect()}
    groups = collections.defaultdict(list)
    for c, *rest in rows:
        groups[c].append(tuple(rest))
    got = {r["conv_id"]: r.asDict() for r in found.collect()}
    assert got.keys() == groups.keys()
    for conv, mine in groups.items():
        want = plain_repair(mine)
        sha = want.pop("sha")
        got[conv].pop("conv_id")
        assert got[conv] == want, conv
        assert hashes.get(conv, hashlib.sha256(b"").hexdigest()) == sha, conv


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_is_the_cheapest(spark, seed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several tasks, also of little data
    try:
        check_repairs(spark, logs(seed))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repair_of_one_conversation_in_one_task(spark):
    check_repairs(spark, [(1, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(600)])


def test_no_conversations(spark):
    none = spark.createDataFrame([], LOGS)
    found = repair.repairs(repair.damaged(none))
    assert found.collect() == [] and repair.repaired_rows(none, found).collect() == []
    assert repair.digests(repair.repaired_rows(none, found)).collect() == []


def test_very_long_text(spark):
    check_repairs(spark, [(1, 0, "user", "x " * 500_000 + "."), (1, 1, "assistant", " " * 500_000), (1, 2, "assistant", ".. " * 99_999)])


def test_repaired_rows_show_the_edits(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "U?"), (1, 2, "user", "again"), (1, 3, "assistant", "A!"), (1, 4, "assistant", "")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repairs(docs)
    assert [r["audit"] for r in found.collect()] == ["KKDKD"]
    out = [(r["position"], r["turn"], r["role"], r["edit"]) for r in repair.repaired_rows(docs, found).collect()]
    assert out == [(0, 0, "system", "K"), (1, 1, "user", "K"), (2, 3, "assistant", "K")]


def test_stretches_join_like_rows():
    rng = random.Random(5)
    rows = [repair.row_items(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(700)]
    run = repair.Stretches()
    for r in rows:
        run.add(r)
    direct = {p: repair.lightest(rows, p) for p in repair.NEXT}
    assert {p: sorted(v) for p, v in run.items().items()} == {p: sorted(v) for p, v in direct.items()}
    assert run.repair() == repair.lightest(rows, repair.START, repair.GOALS)[0][1:]


# source divergence


def plain_divergences(docs, min_docs, top):
    token = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    counts, held, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = token.findall((text or "").translate(lower))
        counts.update((lang, source, t) for t in terms)
        held.update((lang, t) for t in set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (g, t), n in held.items() if g == lang and n >= min_docs]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(count):
            whole = sum(count(t) for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count(t) + 1) // whole for t in kept}

        p = {s: shares(lambda t, s=s: counts[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(counts[lang, s, t] for s in sources))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                for rank, (value, item) in enumerate(rows, 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


DOCS = "doc_id long, text string, lang string, source string, n int, term string, bits string, own int"


def check_divergences(spark, docs, **kw):
    df = spark.createDataFrame([(i, *d, 1, "t", "b", 3) for i, d in enumerate(docs)], DOCS).repartition(3)
    got = source_audit.divergences(df, **kw).collect()
    rows = {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got}
    assert len(rows) == len(got) and rows == plain_divergences(docs, kw["min_docs"], kw["top"])


def corpus(seed, sources=9, n=120):
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdé𝔘ß')}{rng.choice('XyzÉ')}{i}" for i in range(60)]
    words = [re.sub(r"\d", lambda m: "qwertzuiop"[int(m[0])], w) for w in words]
    weights = [1 / (i + 1) for i in range(60)]
    docs = []
    for i in range(n):
        text = rng.choice([" ", "-", "1"]).join(rng.choices(words, weights, k=rng.randrange(60)))
        docs.append((text, rng.choice(["en", "en", "de", None]), rng.choice([f"s{j}" for j in range(sources)] + [None, ""])))
    return docs + [docs[0]] * 5


@pytest.mark.parametrize("block", [64, 2])
def test_divergences(spark, monkeypatch, block):
    monkeypatch.setattr(source_audit, "BLOCK", block)
    odd = [(None, None, None), ("", "fr", "s1"), ("12 34", "fr", "s2"), ("only once", "it", "s"), ("Aé" * 30_000, "en", "s1"), (None, "fr", None)]
    check_divergences(spark, corpus(3) + odd, min_docs=3, top=7)


def test_no_documents(spark):
    assert source_audit.divergences(spark.createDataFrame([], DOCS)).collect() == []


def test_no_term_is_frequent_enough(spark):
    check_divergences(spark, [("a b c", "en", "x"), ("d e", "en", "y")], min_docs=3, top=5)


def test_shares_beyond_64_bits():
    n, total, terms = (np.array([x], np.int64) for x in (4 * 10**14, 9 * 10**14, 10**9))
    assert source_audit.share(n, total, terms)[0] == 1 + 10**9 * (4 * 10**14 + 1) // (9 * 10**14 + 10**9)


def test_shares_as_columns(spark):
    rows = [(0, 5, 7), (10**9 - 1, 10**10, 3), (10**9, 10**10, 3), (4 * 10**14, 9 * 10**14, 10**9), (0, 0, 0)]
    df = spark.createDataFrame(rows, "n long, total long, terms long")
    got = [r[0] for r in df.select(source_audit._share(*map(df.__getitem__, df.columns))).collect()]
    assert got == [1 + 10**9 * (n + 1) // (t + v) if t + v else None for n, t, v in rows]


def test_large_chunks_are_halved(monkeypatch):
    monkeypatch.setattr(source_audit, "WORDS", 40)
    rng = np.random.default_rng(1)
    ids, sources, counts = np.repeat(np.arange(500), 3), np.tile(np.arange(3), 500), rng.integers(1, 4, 1500)
    found = list(source_audit._bitmaps("en", "t", ids, sources, counts, 500))
    assert len(found) > 1 and len({b.column("chunk")[0].as_py() for b in found}) == len(found)
    n = collections.Counter()
    for batch in found:
        for r in batch.to_pylist():
            n[r["source_key"], r["n"]] += int(np.bitwise_count(np.frombuffer(r["bits"], np.uint64)).sum())
    assert n == collections.Counter(zip(sources.tolist(), counts.tolist()))


# embeddings


def plain_links(rows, least):
    def usable(v, x):
        return v is not None and x and all(c is not None and math.isfinite(c) for c in x) and any(x)

    n, component = [0] * len(rows), [r[0] for r in rows]
    links = []
    for a, b in itertools.combinations(range(len(rows)), 2):
        (v, x), (w, y) = rows[a], rows[b]
        if usable(v, x) and usable(w, y) and len(x) == len(y) and embedding_join._cosine(np.array(x, float), np.array(y, float)) >= least:
            links.append((a, b))
            n[a] += 1
            n[b] += 1
    for _ in rows:
        for a, b in links:
            component[a] = component[b] = min(component[a], component[b])
    return sorted(((v, k, c, c is None or v == c) for (v, _), k, c in zip(rows, n, component)), key=repr)


def check_links(spark, rows, kind="float"):
    df = spark.createDataFrame([(v, x, 1, "n", 2) for v, x in rows], f"vec_id long, embedding array<{kind}>, label int, node string, copies int")
    got = embedding_join.near_vectors(df.repartition(3), least=0.9).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=repr) == plain_links(rows, 0.9)


def clouds(seed, n=160, d=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    spread = rng.choice([0.02, 0.3, 0.42], n)[:, None]
    x = (centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, d))).astype(np.float32).astype(float)
    return [(1000 - i, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [8192, 16])
def test_links(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    rows = clouds(2)
    rows += [(i, rows[3][1]) for i in range(20)] + [(rows[5][0], rows[5][1]), (rows[6][0], rows[9][1])]
    rows += [
        (2001, None), (2002, []), (2003, [0.0] * 20), (2004, [1.0, None]), (2005, [float("nan")] * 20), (2006, [float("inf")] + [0.0] * 19),
        (None, rows[3][1]), (2007, [-0.0, 1.0]), (2008, [0.0, 2.0]), (2009, [3.0]), (2010, [-3.0]), (2011, [0.5]), (2001, None),
    ]
    check_links(spark, rows)


def test_links_at_the_threshold(spark):
    # the cosine of the first two is 0.9 within rounding; huge and tiny components
    rows = [(1, [1.0, 0.0, 0.0]), (2, [9.0, math.sqrt(19.0), 0.0]), (3, [1e300, 1e300, 0.0]), (4, [1e-300, 1.1e-300, 0.0]), (5, [0.9, math.sqrt(0.19) + 1e-12, 0.0])]
    check_links(spark, rows, "double")


def test_no_embeddings(spark):
    none = "vec_id long, embedding array<float>"
    assert embedding_join.near_vectors(spark.createDataFrame([], none)).collect() == []
    check_links(spark, [(1, None), (2, [0.0, 0.0])])


def test_halving_inside_a_task(monkeypatch):
    monkeypatch.setattr(embedding_join, "TILE", 8)
    rows = clouds(4, 90)
    side = [i % 2 for i in range(90)]
    table = pa.table({
        "at": list(range(90)), "copies": [1 + i % 3 for i in range(90)], "side": pa.array(side, pa.int32()),
        "vector": pa.array([x for _, x in rows], pa.list_(pa.float64())),
    })
    got = {r["node"]: r["n"] for r in embedding_join._Meeting(table, 0.9, None).table().to_pylist()}
    want = collections.Counter()
    for a, b in itertools.permutations(range(90), 2):
        if side[a] != side[b] and embedding_join._cosine(np.array(rows[a][1]), np.array(rows[b][1])) >= 0.9:
            want[a] += 1 + b % 3
    assert got == dict(want)
