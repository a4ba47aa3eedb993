"""Substring dedup by suffix trees of small groups of texts.

A suffix of each word is not shipped. ``repeats`` names each window by an anchor
gram and brings the windows that may be equal, with the text around them, into
groups of bounded size; where a group is too large, the common core that names it
grows until its parts are small. Texts that are equal as a whole meet in an
aggregate instead. Every group gets the suffix tree of its texts, cut off at
``window`` words. An internal node that deep is a repeat of two leaves or more, a
window in each, and the smallest document among its leaves keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, words
from .repeats import NO_ID, Rule, Scheme, covered, keyed, repeated_spans, word_symbols
from .suffixes import Suffixes, internal_nodes, suffixes

WINDOW, GRAM = 50, 10


def beyond_first(s: Suffixes, depth: int, doc: np.ndarray) -> np.ndarray:
    """Of every suffix: has a node of ``depth`` symbols above it a leaf of a smaller document."""
    out = np.zeros(len(doc), bool)
    first, last, _ = internal_nodes(s, depth)
    if len(first) == 0:
        return out
    size = last - first + 1
    leaves = s.order[ragged(first, size)]
    smallest = np.minimum.reduceat(doc[leaves], np.cumsum(size) - size)
    out[leaves[doc[leaves] > np.repeat(smallest, size)]] = True
    return out


def _judge(window: int):
    def judge(group: dict) -> np.ndarray:
        return beyond_first(suffixes(group["symbols"].values, 1, window, group["at"]), window, group["doc"])

    return judge


def drop_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text) of every document.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of a document.
    Removes each word covered by a window that also starts in a document with a
    smaller doc_id; windows are judged on the input. Kept words are joined by one
    space. A NULL text has no words; repeated rows, and rows of one id, do not
    remove each other's words; a NULL doc_id orders last. Other columns are not
    read.
    """
    texts = keyed(docs)
    rule = Rule(F.col("doc") > F.col("first.doc"), _judge(window))
    spans = repeated_spans(texts, Scheme(word_symbols, window, gram), rule)
    joined = texts.join(spans, ["doc", "tie"], "left").select("doc", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_py().encode()
                data = np.frombuffer(raw, np.uint8)
                starts, ends, _ = words(data, np.array([0, len(data)]))
                keep = np.flatnonzero(~covered(found.as_py(), len(starts))).tolist()
                kept = b" ".join([raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())])
                out.append((len(starts), len(starts) - len(keep), kept.decode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array([o[k] for o in out], pa.int64()) for k in range(2)],
                 pa.array([o[2] for o in out], pa.string())],
                names=["doc", "n_words", "n_removed", "kept"],
            )

    cut_rows = joined.mapInArrow(cut, "doc long, n_words long, n_removed long, kept string")
    return cut_rows.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept")
