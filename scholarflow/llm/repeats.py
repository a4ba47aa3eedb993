"""Finding repeated windows of symbols (bytes or words) across all documents.

Comparing every window with every other would shuffle a row per symbol. Instead
each window is named by an anchor: of the grams in the window the one with the
smallest hash, the first of equals. Windows of equal content have their anchors
at the same place, so windows can only be equal where their anchors' grams are.
Consecutive windows share an anchor; an anchor row stands for all of its windows
(its *context*, the text that they cover), and there are two rows per
(window - gram) symbols.

1. Anchors whose gram occurs once are dropped.
2. Anchors with equal contexts meet in an aggregate: count and first occurrence.
3. Of grams with several different contexts, each context goes once to the group
   of its gram, where the suffixes of its texts (``suffixes``) show which windows they share. Where a
   gram has many contexts, its windows are split by their distance to the anchor;
   the windows of a part share a longer core than the gram, which splits the group,
   and parts of equal text meet in an aggregate again. This goes on until groups
   are small, at the latest at single windows.
4. What holds for a context then holds for all anchors that have it.

Nothing is sampled: every window has an anchor, and every anchor is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, mix, powers, prefix_hashes, ragged, slices, span_hashes, staged, words

# contexts that a group holds at most, and bytes that several groups are judged
# together in; they bound the memory of a task
MOST_CONTEXTS = 64
GROUP_BYTES = 1 << 20
PARTS = 4
_POSITION = np.uint64((1 << 28) - 1)
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Symbols:
    """Texts as symbols: values, the first symbol of each text, bytes of a symbol."""

    values: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    at = np.arange(len(data))
    return Symbols(byte_values(data), offsets, at, at + 1)


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> Symbols:
    starts, ends, first = words(data, offsets)
    return Symbols(span_hashes(prefix_hashes(byte_values(data)), starts, ends), first, starts, ends)


@dataclass(frozen=True)
class Scheme:
    """``window`` symbols make a window, ``gram`` symbols a gram."""

    symbols: Callable[[np.ndarray, np.ndarray], Symbols]
    window: int
    gram: int


def _grams(prefix: np.ndarray, n: int) -> np.ndarray:
    m = len(prefix) - n
    with np.errstate(over="ignore"):
        return mix((prefix[n:] - prefix[:m]) * powers(m, True) + np.uint64(n))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(s: Symbols, scheme: Scheme) -> dict[str, np.ndarray]:
    """The anchors of all windows: text, gram, context (hashes), at, span, lead.

    An anchor's windows start at symbols ``at`` to ``at + span`` of its text, and
    the anchor itself is at ``at + lead``.
    """
    n, window = len(s.values), scheme.window
    none = dict.fromkeys(("text", "gram", "context", "at", "span", "lead"), np.zeros(0, np.int64))
    if n < window:
        return none
    prefix = prefix_hashes(s.values)
    gram = _grams(prefix, scheme.gram)
    key = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    place = (_sliding_min(key, window - scheme.gram + 1) & _POSITION).astype(np.int64)
    end = np.repeat(s.first[1:], np.diff(s.first))[: len(place)]
    valid = np.flatnonzero(np.arange(window, window + len(place)) <= end)
    if len(valid) == 0:
        return none
    place = place[valid]
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    low, high = valid[new], valid[np.append(new[1:], len(valid)) - 1]
    place = place[new]
    text = np.searchsorted(s.first, low, "right") - 1
    shape = mix(((place - low) << 32 | (high - low)).astype(np.uint64))
    return {
        "text": text,
        "gram": gram[place].view(np.int64),
        "context": mix(span_hashes(prefix, low, high + window) ^ shape).view(np.int64),
        "at": low - s.first[text],
        "span": high - low,
        "lead": place - low,
    }


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, tie, text): the id, a NULL one as the largest; a hash of the text; the text.

    Rows of one id and one text are the same document to the joins below; each of
    them still counts as an occurrence of its own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), text.alias("text")).select(
        "doc", F.hash("text").alias("tie"), "text"
    )


_CONTEXT = "gram long, context long, doc long, tie int, at int, span int, lead int"


def _anchor_rows(docs: DataFrame, scheme: Scheme) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in slices(batch, "text"):
                a = anchors(scheme.symbols(data, offsets), scheme)
                row = pa.array(a["text"] + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a["gram"]), pa.array(a["context"]),
                        batch.column("doc").take(row), batch.column("tie").take(row),
                        *[pa.array(a[k].astype(np.int32)) for k in ("at", "span", "lead")],
                    ],
                    names=["gram", "context", "doc", "tie", "at", "span", "lead"],
                )

    return docs.mapInArrow(find, _CONTEXT)


def _extracted(docs: DataFrame, contexts: DataFrame, scheme: Scheme) -> DataFrame:
    """The contexts with ``kinds`` and ``body``, the text that they cover."""
    names = ["gram", "context", "at", "span", "lead", "kinds"]
    lists = contexts.groupBy("doc", "tie").agg(F.collect_list(F.struct(*names)).alias("contexts"))
    joined = docs.join(lists, ["doc", "tie"]).select("doc", "tie", "text", "contexts")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "text"):
                s = scheme.symbols(data, offsets)
                listed = batch.column("contexts").slice(lo, hi - lo)
                flat = listed.flatten()
                row = np.repeat(np.arange(hi - lo), np.diff(listed.offsets.to_numpy()))
                c = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
                low = s.first[row] + c["at"].to_numpy()
                begin, end = s.starts[low], s.ends[low + c["span"].to_numpy() + scheme.window - 1]
                body = data[ragged(begin, end - begin)]
                bounds = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        c["gram"], c["context"], batch.column("doc").take(at), batch.column("tie").take(at),
                        c["at"], c["span"], c["lead"], c["kinds"],
                        pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(body)]),
                    ],
                    names=["gram", "context", "doc", "tie", "at", "span", "lead", "kinds", "body"],
                )

    return joined.mapInArrow(extract, f"{_CONTEXT}, kinds long, body binary")


def _bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins and the last ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _split(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows of contexts, cut by distance to the anchor.

    A row stands for windows r0 to r1 of its context, those with distances near to
    far; its parts have equal ranges of distances. All windows of a part hold a
    core, whose hash (with the range) is the part's ``key``; equal windows have
    equal distances, so their parts have equal keys. ``part`` hashes all of its text.
    """
    schema = (
        "key long, part long, gram long, context long, doc long, tie int, at int,"
        " span int, lead int, r0 int, r1 int, near int, far int, body binary"
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch, "body"):
                s = scheme.symbols(data, offsets)
                prefix = prefix_hashes(s.values)
                row = np.arange(hi - lo)
                c = {k: batch.column(k).slice(lo, hi - lo).to_numpy().astype(np.int64) for k in ("at", "r0", "r1", "span", "lead", "near", "far")}
                wide = c["far"] - c["near"] + 1
                for j in range(PARTS):
                    near, far = c["near"] + j * wide // PARTS, c["near"] + (j + 1) * wide // PARTS - 1
                    r0, r1 = np.maximum(c["r0"], c["lead"] - far), np.minimum(c["r1"], c["lead"] - near)
                    use = np.flatnonzero((near <= far) & (r0 <= r1))
                    zero = s.first[row[use]]  # the context's first symbol
                    place = zero + c["lead"][use]
                    core = span_hashes(prefix, place - near[use], place - far[use] + scheme.window)
                    key = mix(core ^ mix((near[use] << 32 | far[use]).astype(np.uint64)))
                    nearest, farthest = (c["lead"] - r1)[use], (c["lead"] - r0)[use]
                    shape = mix((nearest << 32 | farthest).astype(np.uint64))
                    part = mix(span_hashes(prefix, zero + r0[use], zero + r1[use] + scheme.window) ^ shape)
                    at = pa.array(use + lo)
                    same = {k: batch.column(k).take(at) for k in ("gram", "context", "doc", "tie", "span", "lead", "body")}
                    own = {
                        "key": pa.array(key.view(np.int64)), "part": pa.array(part.view(np.int64)),
                        "at": pa.array((c["at"] - c["r0"] + r0)[use].astype(np.int32)),
                        **{k: pa.array(v[use].astype(np.int32)) for k, v in (("r0", r0), ("r1", r1), ("near", near), ("far", far))},
                    }
                    names = [f.split()[0] for f in schema.split(", ")]
                    yield pa.RecordBatch.from_arrays([{**same, **own}[k] for k in names], names=names)

    return rows.mapInArrow(split, schema)


def _runs(context: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive ``r`` of a context as (context, first r, last r); input is in order."""
    if len(r) == 0:
        return r, r, r
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (r[1:] != r[:-1] + 1)]))
    return context[new], r[new], r[np.append(new[1:], len(r)) - 1]


def _in_groups(rows: DataFrame, judge: Callable[[dict], np.ndarray], scheme: Scheme) -> DataFrame:
    """Windows r0 to r1 of the rows' contexts that ``judge`` marks: (gram, context, r0, r1).

    Groups, by ``key``, come one after another in their partition and are judged
    several at a time, about GROUP_BYTES of them.
    """
    given = rows.select("key", "gram", "context", "doc", "tie", "at", "r0", "r1", "body")
    dealt = given.repartition("key").sortWithinPartitions("key", "doc", "tie", "at")

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        data, offsets = _bodies(t.column("body"))
        s = scheme.symbols(data, offsets)
        r0 = t.column("r0").to_numpy().astype(np.int64)
        size = t.column("r1").to_numpy() - r0 + 1
        owner = np.repeat(np.arange(len(size)), size)
        r = ragged(r0, size)
        found = judge({"symbols": s, "data": data, "at": s.first[owner] + r, "doc": t.column("doc").to_numpy()[owner]})
        hit = np.flatnonzero(found)
        row, first, last = _runs(owner[hit], r[hit])
        which = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [
                t.column("gram").take(which), t.column("context").take(which),
                pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
            ],
            names=["gram", "context", "r0", "r1"],
        )

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            key = batch.column("key").to_numpy()
            _, bounds = _bodies(batch.column("body"))
            first = 0
            for end in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
                if size > GROUP_BYTES and key[first] != last:
                    yield settle(held)
                    held, size = [], 0
                held.append(batch.slice(first, end - first))
                size += int(bounds[end] - bounds[first])
                first, last = end, key[end - 1]
        if held:
            yield settle(held)

    return dealt.mapInArrow(process, "gram long, context long, r0 int, r1 int")


@dataclass(frozen=True)
class Rule:
    """Which occurrences of a window go.

    ``members`` says it of a row (doc, tie, at) whose whole text occurs ``n``
    times, first at ``first`` (doc, tie, at); ``judge`` says it of the windows of
    different texts in a group.
    """

    members: Column
    judge: Callable[[dict], np.ndarray]


def is_first() -> Column:
    return (F.col("doc") == F.col("first.doc")) & (F.col("tie") == F.col("first.tie")) & (F.col("at") == F.col("first.at"))


def _met(rows: DataFrame, *key: str) -> DataFrame:
    """Equal texts in one row: ``n`` and the first occurrence, ``first``."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tie", "at")).alias("first"))


def _shared(bodies: DataFrame, scheme: Scheme, rule: Rule) -> DataFrame:
    """Windows of different contexts that the rule removes: (gram, context, r0, r1)."""
    rows = bodies.withColumns({"key": F.col("gram"), "r0": F.lit(0), "r1": F.col("span")})
    few, many = F.col("kinds") <= MOST_CONTEXTS, F.col("kinds") > MOST_CONTEXTS
    found = _in_groups(rows.where(few), rule.judge, scheme)
    crowded = rows.where(many).withColumns({"near": F.lit(0), "far": F.lit(scheme.window - scheme.gram)})
    while not crowded.isEmpty():
        parts = staged(_split(crowded, scheme))
        met = staged(_met(parts, "key", "part"))
        kinds = staged(met.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")))
        known = staged(parts.join(met.join(kinds, "key"), ["key", "part"]))
        found = found.unionByName(known.where(rule.members).select("gram", "context", "r0", "r1"))
        # the first of equal parts stands for them in the groups
        open_ = known.where((F.col("kinds") > 1) & (~rule.members | is_first())).drop("part", "n", "first")
        found = found.unionByName(_in_groups(open_.where(few), rule.judge, scheme))
        crowded = open_.where(many)
    return found


def repeated_spans(docs: DataFrame, scheme: Scheme, rule: Rule) -> DataFrame:
    """(doc, tie, spans): what the rule removes, as an array of (start, end) in symbols.

    ``docs`` is as ``keyed`` gives it. Spans may overlap.
    """
    found = _anchor_rows(docs, scheme)
    grams = staged(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    members = staged(found.join(grams, "gram", "left_semi"))
    contexts = staged(_met(members, "gram", "context", "span", "lead"))
    kinds = staged(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    unlike = contexts.join(kinds, "gram").select("gram", "context", "span", "lead", "kinds", "first.doc", "first.tie", "first.at")
    partial = _shared(staged(_extracted(docs, unlike, scheme)), scheme, rule)
    ranges = partial.groupBy("gram", "context").agg(F.collect_list(F.struct("r0", "r1")).alias("ranges"))
    judged = staged(contexts.select("gram", "context", "n", "first").join(ranges, ["gram", "context"], "left"))
    whole = F.array(F.struct(F.lit(0).alias("r0"), F.col("span").alias("r1")))
    marked = members.join(judged, ["gram", "context"]).select(
        "doc", "tie", "at", F.when(rule.members, whole).otherwise(F.col("ranges")).alias("ranges")
    )
    span = F.struct(
        (F.col("at") + F.col("range.r0")).alias("start"),
        (F.col("at") + F.col("range.r1") + scheme.window).alias("end"),
    )
    return (
        marked.where(F.col("ranges").isNotNull())
        .select("doc", "tie", "at", F.explode("ranges").alias("range"))
        .groupBy("doc", "tie").agg(F.collect_list(span).alias("spans"))
    )


def covered(spans, n: int) -> np.ndarray:
    """A flag for each of ``n`` symbols: inside any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(edge, [s["start"] for s in spans], 1)
        np.add.at(edge, [s["end"] for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0
