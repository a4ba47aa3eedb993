"""Windows meet the items that they can be similar to, not all items of their size."""

import random

from pyspark.sql import functions as F

from scholarflow.llm import decontaminate as D


def tables(spark, n, seed=1):
    """n items of 30 words that share a common opening, each in one document, and one document with all."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    opening = "please answer the following question with one word only"
    items = [(i, f"{opening} " + " ".join(word() for _ in range(21))) for i in range(n)]
    around = lambda: " ".join(word() for _ in range(40))
    docs = [(i, f"{around()} {text} {around()}") for i, text in items]
    docs += [(n, " ".join(text for _, text in items)), (n + 1, f"{opening} {around()}"), (n + 2, None), (n + 3, "")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def proposed(docs, benchmark):
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    items = D.staged(D._items(benchmark, "item_id")).withColumn("item", F.monotonically_increasing_id())
    items = D.staged(items)
    hits = D.staged(D._hits(docs, items))
    windows = D.staged(D._windows(docs, D._starts(hits)).distinct())
    return windows.count(), D._proposed(windows, hits, items, 80).count()


def test_pairs_grow_with_the_matches(spark):
    for n in (100, 400):
        windows, pairs = proposed(*tables(spark, n))
        assert windows >= 2 * n and pairs <= 3 * windows
        docs, benchmark = tables(spark, n)
        found = {(r["doc_id"], r["item_id"]) for r in D.contaminations(docs, benchmark).collect()}
        assert found == {(i, i) for i in range(n)} | {(n, i) for i in range(n)}


def test_a_pair_needs_a_rare_shingle_only(spark):
    """Edited copies at the threshold are still proposed: one to three words of 60 changed."""
    rng = random.Random(5)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(30)]
    items = [(i, " ".join(w)) for i, w in enumerate(words)]
    docs = []
    for i, w in enumerate(words):
        for k in range(4):
            edited = list(w)
            for j in rng.sample(range(60), k):
                edited[j] = "edited"
            docs.append((4 * i + k, "before it " + " ".join(edited) + " after"))
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminations(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}

    def shingles(text):
        w = text.split()
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    want = set()
    for d, text in docs:
        found = shingles(text)
        for i, item in items:
            own = shingles(item)
            for s in range(len(found) - len(own) + 1):
                common = len(set(own) & set(found[s : s + len(own)]))
                if 100 * common >= 80 * (2 * len(own) - common):
                    want.add((d, i))
    assert got == want and len(want) > 60
