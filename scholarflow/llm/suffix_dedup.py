"""Removing repeated byte strings by longest previous factors.

The array of longest previous factors tells for every place how many of the bytes
from there on also occur from an earlier place on. It is read off the suffixes in
suffix order: of those that start earlier, the nearest one on either side shares
the most. A byte goes if a window that covers it starts where the factor is as
long as the window. Where no copy is to stay, the same array of later factors
tells of the other occurrences.

A suffix of each byte is not shipped, nor one array made of all texts: ``repeats``
deals windows, with the text around them, into groups of bounded size so that
windows of equal content always meet, and each group has its array, cut off at the
window. Texts that are equal as a whole meet in an aggregate instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import NO_ID, Rule, Scheme, byte_symbols, covered, is_first, keyed, repeated_spans
from .suffixes import longest_previous_factors, suffixes

WINDOW, GRAM = 200, 48


def _leading(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as a number that orders alike."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    return out


def _judge(window: int, keep: str):
    def judge(group: dict) -> np.ndarray:
        # groups come in order of document and position
        s = suffixes(_leading(group["data"]), 8, window, group["at"])
        factor = longest_previous_factors(s)
        if keep == "none":
            factor = np.maximum(factor, longest_previous_factors(s, later=True))
        return factor >= window

    return judge


def _rule(window: int, keep: str) -> Rule:
    return Rule(F.col("n") > 1 if keep == "none" else ~is_first(), _judge(window, keep))


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, keep: str = "first") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document.

    Removes the bytes covered by a ``window``-byte string that also starts
    earlier (``keep="first"``; the order is doc_id, then position) or anywhere
    else (``keep="none"``), in this document or another one. Texts are UTF-8
    bytes, a NULL text is empty, no match crosses documents, and strings are
    judged on the input. ``n_spans`` counts maximal runs of removed bytes. With
    ``keep="none"`` repeated rows remove each other; with ``keep="first"`` they
    are one document and stay alike. A NULL doc_id orders last. Other columns are
    not read.
    """
    texts = keyed(docs)
    scheme = Scheme(byte_symbols, window, gram)
    spans = repeated_spans(texts, scheme, _rule(window, keep))
    joined = texts.join(spans, ["doc", "tie"], "left").select("doc", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column("text"), batch.column("spans")):
                raw = text.as_py().encode()
                gone = covered(found.as_py(), len(raw))
                runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if runs else raw
                out.append((len(raw), len(raw) - len(kept), runs, kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *[pa.array([o[k] for o in out], pa.int64()) for k in range(3)],
                 pa.array([o[3] for o in out], pa.binary())],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    cut_rows = joined.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut_rows.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
