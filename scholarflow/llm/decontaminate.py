"""Benchmark decontamination by SimHash of item-sized windows.

For every benchmark item, the windows of a document that are as long as the item
(in words) get a 64-bit SimHash of their weighted word shingles, and so does the
item. Fingerprints within a Hamming radius are found by a multi-index: of eight
blocks of eight bits at least one differs in no more than radius / 8 bits, so an
item is listed under all block values that near to its own. Pairs found are
verified by the exact weighted similarity of their shingles.

Everything is DataFrame and SQL functions. Windows of which less than half of
the shingles occur in items of their size cannot reach the similarity and get no
fingerprint; that is what keeps the work in proportion to the text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

SHINGLE = 5
PERCENT = 80
# similarity 0.8 is an angle of 27 degrees, 9.7 of 64 bits in the mean, with a
# standard deviation of 2.9; the radius lies 4.6 deviations above the mean
RADIUS = 23
BLOCKS, BLOCK_BITS = 8, 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; NULL has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def shingle_list(words: str, k: str) -> Column:
    """The hashes of all runs of ``k`` words, in order; none if there are fewer words."""
    return F.expr(
        f"CASE WHEN size({words}) >= {k} THEN"
        f" transform(sequence(1, size({words}) - {k} + 1), i -> xxhash64(slice({words}, i, {k})))"
        f" ELSE array() END"
    ).cast("array<bigint>")


def simhash(shingles: str) -> Column:
    """Bit b is set if more than half of the shingles (repeats count) have it set."""
    return F.expr(
        "aggregate(sequence(0, 63), 0L, (acc, b) -> acc | CASE WHEN 2 * size(filter("
        f"{shingles}, x -> shiftright(x, b) & 1 = 1)) > size({shingles}) THEN shiftleft(1L, b) ELSE 0L END)"
    )


def _block(fingerprint: str, j: int) -> Column:
    return F.shiftrightunsigned(fingerprint, BLOCK_BITS * j).bitwiseAND(2**BLOCK_BITS - 1)


def _near_values(bits: int) -> list[int]:
    """Masks that flip up to ``bits`` of a block's bits."""
    return [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(BLOCK_BITS), n)]


def _common(a: str, b: str) -> Column:
    """Sum over shingles of the smaller of the two counts."""
    return F.expr(
        f"CASE WHEN size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b})"
        f" THEN size(array_intersect({a}, {b}))"
        f" ELSE aggregate(array_distinct({b}), 0, (acc, x) -> acc +"
        f" least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))) END"
    )


def _items(benchmark: DataFrame, item_id: str) -> DataFrame:
    """One row per distinct text of an item: item_id, m words, k, shingles."""
    return (
        benchmark.select(F.col(item_id).alias("item_id"), word_list(F.col("text")).alias("words"))
        .where(F.size("words") > 0)
        .distinct()
        .select("item_id", "words", F.size("words").alias("m"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k"))
        .select("item_id", "m", "k", shingle_list("words", "k").alias("item_shingles"))
    )


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, tie, n shingles, pos, hash, m, k: where a shingle of an item of m words occurs."""
    known = items.select(F.explode("item_shingles").alias("hash"), "m", "k").distinct()
    sizes = [r["k"] for r in items.select("k").distinct().collect()] or [SHINGLE]  # 1 to 5
    hits = None
    for k in sizes:
        text = docs.select("doc_id", "tie", word_list(F.col("text")).alias("words"))
        listed = text.select("doc_id", "tie", shingle_list("words", str(k)).alias("found"))
        each = listed.select("doc_id", "tie", F.size("found").alias("n"), F.posexplode_outer("found").alias("pos", "hash"))
        hit = each.join(known.where(F.col("k") == k), "hash").select("doc_id", "tie", "n", "pos", "hash", "m", "k")
        hits = hit if hits is None else hits.unionByName(hit)
    return hits.distinct()


def _starts(hits: DataFrame) -> DataFrame:
    """Runs of window starts worth a fingerprint: doc_id, tie, m, k, lo, hi.

    Each shingle that occurs in an item of m words is a hit for the windows of m
    words that hold it; a running sum over a document's hits gives, for every
    start, how many hits its window has.
    """
    length = F.col("m") - F.col("k") + 1
    gain = F.struct((F.col("pos") - length + 1).alias("at"), F.lit(1).alias("step"))
    loss = F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("step"))
    per_window = ["doc_id", "tie", "m", "k", "n"]
    steps = (
        hits.select(*per_window, F.explode(F.array(gain, loss)).alias("e"))
        .groupBy(*per_window, F.col("e.at").alias("at")).agg(F.sum("e.step").alias("step"))
    )
    order = W.partitionBy(*per_window).orderBy("at")
    runs = steps.select(
        *per_window, "at",
        F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("hits"),
        F.lead("at").over(order).alias("following"),
    ).where(2 * F.col("hits") >= length)
    return runs.select(
        "doc_id", "tie", "m", "k",
        F.greatest("at", F.lit(0)).alias("lo"),
        F.least(F.col("following") - 1, F.col("n") - length).alias("hi"),
    ).where("lo <= hi")


def _windows(docs: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, tie, k, m, start, shingles, fingerprint of the windows at ``starts``."""
    per_doc = starts.groupBy("doc_id", "tie", "k").agg(F.collect_list(F.struct("m", "lo", "hi")).alias("runs"))
    # shuffled at every size: how many documents have starts depends on the data alone
    joined = docs.join(
        per_doc.withColumnsRenamed({"doc_id": "s_doc_id", "tie": "s_tie"}).hint("merge"),
        F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("tie") == F.col("s_tie")),
    )
    # explode_outer: for explode, a filter on the array's size is inferred and pushed
    # below the arrays' own projections, which evaluates them again for every element
    listed = joined.select("doc_id", "tie", "k", "runs", word_list(F.col("text")).alias("words"))
    listed = listed.select("doc_id", "tie", "k", "runs", shingle_list("words", "k").alias("found"))
    cut = listed.select(
        "doc_id", "tie", "k",
        F.explode_outer(F.expr(
            "flatten(transform(runs, r -> transform(sequence(r.lo, r.hi), s ->"
            " struct(r.m AS m, s AS start, slice(found, s + 1, r.m - k + 1) AS shingles))))"
        )).alias("w"),
    )
    return cut.where(F.col("w").isNotNull()).select("doc_id", "tie", "k", "w.*").withColumn("fingerprint", simhash("shingles"))


def _proposed(windows: DataFrame, hits: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """The windows, each once with every item that it can be similar to.

    At the similarity s a window of L shingles shares at least 2 s L / (1 + s) of
    them with the item, so of any L - that + 1 of the item's shingles it holds
    one. Those that the fewest items have are looked for: where one is hit,
    the windows around it meet the item. Hits and windows are brought together by
    runs of L starts, so a text with very many items is no group of its own.
    """
    length = F.col("m") - F.col("k") + 1
    needed = F.ceil(2 * percent * length / F.lit(100 + percent) - 1e-9)
    each = items.select("item", "m", "k", F.posexplode("item_shingles").alias("no", "hash"))
    often = each.groupBy("hash", "m").agg(F.count_distinct("item").alias("often"))
    rarest = W.partitionBy("item").orderBy("often", "hash", "no")
    rare = (
        each.join(often, ["hash", "m"]).withColumn("rank", F.row_number().over(rarest))
        .where(F.col("rank") <= length - needed + 1)
        .select("item", "m", "k", "hash").distinct()
    )
    lo, hi = F.greatest(F.col("pos") - length + 1, F.lit(0)), F.col("pos")
    run = lambda c: F.floor(c / length).cast("long")
    around = (
        hits.join(rare, ["hash", "m", "k"])
        .select("doc_id", "tie", "m", "item", lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(run(lo), run(hi))).alias("run"))
        .groupBy(F.col("doc_id").alias("a_doc_id"), F.col("tie").alias("a_tie"), F.col("m").alias("a_m"), "item", F.col("run").alias("a_run"))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    placed = windows.select("doc_id", "tie", "m", "start", "fingerprint", run(F.col("start")).alias("run"), "k")
    on = (
        F.col("doc_id").eqNullSafe(F.col("a_doc_id")) & (F.col("tie") == F.col("a_tie")) & (F.col("m") == F.col("a_m"))
        & (F.col("run") == F.col("a_run")) & F.col("start").between(F.col("lo"), F.col("hi"))
    )
    return placed.join(around.hint("merge"), on).select("doc_id", "tie", "m", "start", "fingerprint", "item")


def contaminations(docs: DataFrame, benchmark: DataFrame, *, percent: int = PERCENT, radius: int = RADIUS,
                   item_id: str = "item_id") -> DataFrame:
    """One row per document and item it contains: doc_id, tie, item_id,
    similarity, n_windows, start, n_words.

    A document contains an item if a window of as many words as the item has
    reaches the similarity, that is, 100 * (sum of the smaller counts) >=
    ``percent`` * (sum of the larger counts) over the shingles of both, five
    words each, or all words of a shorter item. ``similarity`` is that of the
    best window, ``start`` its first word (from 0; the first of equals) and
    ``n_windows`` says how many windows reach it. Clean documents have no row.
    ``tie`` is a hash of the document's text; repeated rows give one row here.
    NULL and empty texts, of documents or items, contain and match nothing.
    Other columns are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    items = staged(_items(benchmark, item_id)).withColumn("item", F.monotonically_increasing_id())
    items = staged(items.withColumn("item_print", simhash("item_shingles")))
    hits = staged(_hits(docs, items))
    windows = staged(_windows(docs, staged(_starts(hits))).distinct())
    within = radius // BLOCKS
    masks = F.array(*[F.lit(v).cast("bigint") for v in _near_values(within)])
    blocks = lambda name: F.posexplode(F.array(*[_block(name, j) for j in range(BLOCKS)])).alias("block", "value")
    listed = (
        items.select("item", "item_print", blocks("item_print"))
        .select("item", "item_print", "block", F.explode(F.transform(masks, lambda v: F.col("value").bitwiseXOR(v))).alias("value"))
    )
    proposed = _proposed(windows, hits, items, percent)
    probes = proposed.select("doc_id", "tie", "m", "start", "fingerprint", "item", blocks("fingerprint"))
    apart = F.col("fingerprint").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*[
        F.when(F.bit_count(F.shiftrightunsigned(apart, BLOCK_BITS * j).bitwiseAND(2**BLOCK_BITS - 1)) <= within, F.lit(j))
        for j in range(BLOCKS)
    ])
    near = (
        probes.join(listed, ["item", "block", "value"])
        .where((F.bit_count(apart) <= radius) & (F.col("block") == first))  # each pair by one block
        .select(F.col("doc_id").alias("p_doc_id"), F.col("tie").alias("p_tie"), F.col("m").alias("p_m"),
                F.col("start").alias("p_start"), "item")
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & (F.col("tie") == F.col("p_tie"))
        & (F.col("m") == F.col("p_m")) & (F.col("start") == F.col("p_start"))
    )
    verified = (
        windows.join(near, same)
        .join(items.select("item", "item_id", "item_shingles"), "item")
        .withColumn("common", _common("shingles", "item_shingles"))
        .withColumn("either", F.size("shingles") + F.size("item_shingles") - F.col("common"))
        .where(F.col("common") * 100 >= F.col("either") * percent)
        .withColumn("similarity", F.col("common") / F.col("either"))
    )
    best = F.max_by(F.struct("start", "m"), F.struct("similarity", -F.col("start"), -F.col("m")))
    return verified.groupBy("doc_id", "tie", "item_id").agg(
        F.max("similarity").alias("similarity"),
        F.count(F.lit(1)).alias("n_windows"),
        best.alias("best"),
    ).select(
        "doc_id", "tie", "item_id", "similarity", "n_windows",
        F.col("best.start").cast("long").alias("start"), F.col("best.m").cast("long").alias("n_words"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that contain no benchmark item."""
    bad = staged(contaminations(docs, benchmark, **options).select(
        F.col("doc_id").alias("_bad_id"), F.col("tie").alias("_bad_tie")
    ).distinct())
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_bad_id")) & (tie == F.col("_bad_tie")), "left_anti")
