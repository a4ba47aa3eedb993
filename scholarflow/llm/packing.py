"""Best-fit packing of tokenised documents with matching of the large items.

Documents become pieces of at most ``capacity`` tokens. Which bin a piece goes
to depends on its length alone, so packing works on the table of lengths and
their counts, which has at most ``capacity`` rows however large the corpus is:

1. full pieces fill a bin each;
2. large items, above a third of the capacity, are matched greedily: the largest
   one takes the largest other one that still fits; no bin gets a third one;
3. smaller items, the longest first, go where the gap left is the smallest that
   fits, and into a new bin where none fits.

Bins alike are handled as one group with a count. The result is a table of
slots: the pieces of one length with ranks from .. to go to so many consecutive
bins at one offset. Spark ranks the pieces of each length, in blocks, so that a
length that a large part of the pieces share is no task's alone.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, slices, staged, tidy

CAPACITY = 4096
# distinct words a worker remembers; then it forgets them all and starts anew
CACHE_WORDS = 400_000
# bytes of text that are cut into words at a time in a task
SLICE = 1 << 18
# how this vocabulary's tokenizer cuts lower-case Latin-1 text (fixed values)
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class WordEncoder:
    """Token ids of texts by a lower-casing tokenizer that cuts text into words first.

    A text's ids are those of its words in order, so each distinct word is encoded
    once and kept. Texts in Latin-1 are cut here by the tokenizer's own pattern;
    any other text, and one that may hold a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 18, np.uint32), 0

    def _learn(self, fresh: list[str]) -> None:
        for first in range(0, len(fresh), 4096):
            words = fresh[first : first + 4096]
            found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            ids, n, at = np.array(found.ids, np.uint32), len(words), len(self.rows)
            size = np.bincount(np.array(found.word_ids, np.int64), minlength=n)
            if len(size) != n:
                raise ValueError("this tokenizer does not cut text into the expected words")
            while at + n > len(self.start):
                self.start, self.length = np.tile(self.start, 2), np.tile(self.length, 2)
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.start[at : at + n] = self.n_ids + np.cumsum(size) - size
            self.length[at : at + n] = size
            self.n_ids += len(ids)
            self.rows.update(zip(words, range(at, at + n)))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.rows) > self.cache_words:
            self._forget()
        words: list[str] = []
        ends: list[int] = []
        whole: dict[int, str] = {}
        for i, text in enumerate(texts):
            if text.isascii() or _is_latin(text):
                if "<|" not in text:
                    words += _WORD.findall(text.lower())
                else:
                    whole[i] = text
            else:
                whole[i] = text
            ends.append(len(words))
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(rows < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys([words[i] for i in missing])))
            rows[missing] = [self.rows[words[i]] for i in missing]
        size = self.length[rows]
        ids = self.ids[ragged(self.start[rows], size)]
        bounds = np.concatenate([[0], np.cumsum(size)])[[0, *ends]]
        for i in range(len(texts)):
            if i in whole:
                yield np.array(self.tokenizer.encode(whole[i], add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[bounds[i] : bounds[i + 1]]


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 1,
           keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, tie (and ``keep``).

    A document's ids are the tokenizer's and then ``end_id``; a NULL text counts
    as empty, so every document has a piece. Longer documents are cut into pieces
    of ``capacity`` ids. ``tie`` is a hash of the text, for an order among rows
    that share an id; repeated rows are packed as often as they come.
    """
    given = docs.select(
        F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), *keep).alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            owner, out = [], []
            for lo, hi, _, _ in slices(batch, "text", SLICE):
                texts = batch.column("text").slice(lo, hi - lo).to_pylist()
                for i, found in enumerate(encode.encode(texts), lo):
                    ids = np.append(found, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        owner.append(i)
                        out.append((piece, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(owner, pa.int64())),
                 pa.array([o[0] for o in out], pa.int32()),
                 *[pa.array([o[k] for o in out], pa.int64()) for k in (1, 2, 3)]],
                names=["row", "piece", "start", "length", "ids_crc32"],
            )

    schema = given.select("row").schema.add("piece", "integer")
    for name in ("start", "length", "ids_crc32"):
        schema = schema.add(name, "long")
    return given.mapInArrow(tidy(cut), schema).select("row.*", "piece", "start", "length", "ids_crc32")


@dataclass
class Group:
    """``count`` bins that hold items of the same lengths."""

    count: int
    lengths: tuple[int, ...]
    gap: int


def match_and_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Bins for ``counts`` items of each length, by the three steps of the module."""
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    done: list[Group] = []
    gaps: dict[int, list[Group]] = {}
    order: list[int] = []  # the gaps there are, ascending

    def put(group: Group) -> None:
        if group.gap == 0:
            done.append(group)
            return
        if group.gap not in gaps:
            gaps[group.gap] = []
            bisect.insort(order, group.gap)
        gaps[group.gap].append(group)

    def take(gap: int) -> Group:
        group = gaps[gap].pop()
        if not gaps[gap]:
            del gaps[gap]
            order.pop(bisect.bisect_left(order, gap))
        return group

    while large:
        n = large[-1]
        at = bisect.bisect_right(large, capacity - n) - 1
        if at < 0:
            put(Group(left[n], (n,), capacity - n))
            large.pop()
            continue
        m = large[at]
        if m == n:
            if pairs := left[n] // 2:
                put(Group(pairs, (n, n), capacity - 2 * n))
            left[n] -= 2 * pairs
            if left[n] and at > 0:
                m = large[at - 1]
            elif left[n]:
                put(Group(1, (n,), capacity - n))
                large.pop()
                continue
            else:
                large.pop()
                continue
        together = min(left[n], left[m])
        put(Group(together, (n, m), capacity - n - m))
        for k in (n, m):
            left[k] -= together
            if left[k] == 0:
                large.pop(bisect.bisect_left(large, k))
    for n in small:
        todo = left[n]
        while todo:
            at = bisect.bisect_left(order, n)
            if at == len(order):
                fit = capacity // n
                if bins := todo // fit:
                    put(Group(bins, (n,) * fit, capacity - fit * n))
                if rest := todo % fit:
                    put(Group(1, (n,) * rest, capacity - rest * n))
                break
            group = take(order[at])
            used = min(group.count, todo)
            put(Group(used, (*group.lengths, n), group.gap - n))
            if used < group.count:
                put(Group(group.count - used, group.lengths, group.gap))
            todo -= used
    return done + [g for groups in gaps.values() for g in groups]


def slots(groups: list[Group]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank."""
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for group in groups:
        offset = 0
        for n in group.lengths:
            out.append((n, rank.get(n, 0), sequence, offset))
            rank[n] = rank.get(n, 0) + group.count
            offset += n
        sequence += group.count
    table = np.array(out, np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def ranked(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` with ``rank``: 0, 1, ... among the rows of a length.

    Ranks are counted inside (length, block) and shifted by the sizes of the
    blocks before, so no length has to meet in one task.
    """
    order = ["doc_id", "tie", "piece"]
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", "piece"), F.lit(blocks)))
    sizes = blocked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("length", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "block").orderBy(*order)
    return (
        blocked.withColumn("inside", F.row_number().over(inside) - 1)
        .join(shift, ["length", "block"])
        .withColumn("rank", F.col("inside") + F.col("shift"))
        .drop("inside", "shift", "block")
    )


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = 1,
         tokens_of: Callable[..., DataFrame] = pieces) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``docs`` needs doc_id and text; other columns are not read. No rows, no
    sequences. The slots that go to the tasks are as many as the items of the
    distinct bins, a number that depends on the spread of lengths (at most
    ``capacity`` of them), not on how many pieces there are.
    """
    cut = staged(tokens_of(docs, tokenizer, capacity=capacity, end_id=end_id))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = slots(match_and_fit(counts, capacity))
    spark = docs.sparkSession
    total = sum(counts.values())
    blocks = max(64, total // 100_000)
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = shared.value
        key = slot[:, 0] << 44 | slot[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(key, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(slot[row, 2] + rank - slot[row, 1]), pa.array(slot[row, 3])],
                names=["row", "sequence_id", "offset"],
            )

    plain = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = ranked(cut, blocks).select(F.struct(*plain).alias("row"), "length", "rank")
    schema = rows.select("row").schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(tidy(place), schema).select("row.*", "sequence_id", "offset")
