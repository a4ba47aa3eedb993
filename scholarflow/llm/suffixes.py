"""Suffixes of a bounded group of texts: their order, common prefixes, tree and factors.

Suffixes are cut off at a depth. All steps are numpy passes over the group, which
the caller bounds; nothing here sees more than one group, or several small ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Suffixes:
    """Suffixes in suffix order, equal ones by place."""

    order: np.ndarray  # which suffix, by its place in ``at``
    shared: np.ndarray  # symbols that it shares with the one before it, at most the depth


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of a difference, from the first on, are zero."""
    return sum((x < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))


def suffixes(values: np.ndarray, base: int, depth: int, at: np.ndarray) -> Suffixes:
    """The suffixes that start at ``at``, all of at least ``depth`` symbols.

    ``values`` order the first ``base`` symbols of every suffix: 1, or 8 bytes in a
    number. Ranks of three adjoining pieces make a key for three times the length,
    until ``depth`` is reached; there are at most 2^21 symbols, so three ranks fit
    in 64 bits. The ranks of all lengths then tell how far neighbours agree.
    """
    n = len(values)
    rank = np.unique(values, return_inverse=True)[1].astype(np.uint64)
    levels = [(base, rank)]

    def joined(where: np.ndarray, second: int, third: int) -> np.ndarray:
        pick = lambda by: rank[np.minimum(where + by, n - 1)]
        return rank[where] << np.uint64(42) | pick(second) << np.uint64(21) | pick(third)

    everywhere, length = np.arange(n), base
    while 3 * length < depth:
        rank = np.unique(joined(everywhere, length, 2 * length), return_inverse=True)[1].astype(np.uint64)
        length *= 3
        levels.append((length, rank))
    last = depth - length
    final = np.unique(joined(at, min(length, last), last), return_inverse=True)[1]
    order = np.argsort(final, kind="stable")
    shared = np.zeros(len(at), np.int64)
    same = final[order[1:]] == final[order[:-1]]
    shared[1:][same] = depth
    unlike = np.flatnonzero(~same) + 1
    a, b = at[order[unlike - 1]], at[order[unlike]]
    so_far = np.zeros(len(unlike), np.int64)
    for size, ranked in reversed(levels):
        for _ in range(2):
            left, right = np.minimum(a + so_far, n - 1), np.minimum(b + so_far, n - 1)
            so_far += size * (ranked[left] == ranked[right])
    if base > 1:
        so_far += _leading_bytes(values[np.minimum(a + so_far, n - 1)] ^ values[np.minimum(b + so_far, n - 1)])
    shared[unlike] = np.minimum(so_far, depth - 1)
    return Suffixes(order, shared)


def previous_smaller(x: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the nearest one before it with a smaller ``x`` (-1: none),
    and the least ``shared`` after that place up to this one.

    All places jump at once: where the candidate is not smaller, its own candidate
    comes next, since what lies between is larger still.
    """
    at, least = np.arange(-1, len(x) - 1), shared.copy()
    moving = np.arange(len(x))
    while True:
        moving = moving[at[moving] >= 0]
        moving = moving[x[at[moving]] >= x[moving]]
        if len(moving) == 0:
            return at, least
        over = at[moving]
        least[moving] = np.minimum(least[moving], least[over])
        at[moving] = at[over]


def next_smaller(x: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``previous_smaller``, after the place (the length of ``x``: none)."""
    back = np.append(shared[1:], 0)[::-1]
    at, least = previous_smaller(x[::-1], back)
    return len(x) - 1 - at[::-1], least[::-1]


def longest_previous_factors(s: Suffixes, later: bool = False) -> np.ndarray:
    """Of every suffix the longest prefix that also starts before it (``later``:
    after it), cut off at the depth.

    Of all suffixes that start earlier, the nearest ones in suffix order on either
    side share the most with it.
    """
    place = -s.order if later else s.order
    before, with_before = previous_smaller(place, s.shared)
    after, with_after = next_smaller(place, s.shared)
    out = np.empty(len(place), np.int64)
    out[s.order] = np.maximum(
        np.where(before >= 0, with_before, 0), np.where(after < len(place), with_after, 0)
    )
    return out


def internal_nodes(s: Suffixes, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The internal nodes of the suffix tree that are ``depth`` symbols deep at least:
    (first leaf, last leaf, symbols), leaves in suffix order.

    A node spans the leaves between the nearest places on both sides where
    neighbours share less than it is deep.
    """
    deep = np.flatnonzero(s.shared >= depth)
    if len(deep) == 0:
        return deep, deep, deep
    # between runs of deep places, stands a place that shares too little
    low = np.concatenate([[True], deep[1:] != deep[:-1] + 1])
    run = np.cumsum(low) - 1
    x = np.full(len(deep) + int(low.sum()), -1, np.int64)
    place = np.arange(len(deep)) + run + 1
    x[place] = s.shared[deep]
    nothing = np.zeros(len(x), np.int64)
    before, after = previous_smaller(x, nothing)[0][place], next_smaller(x, nothing)[0][place]
    first, last = deep - (place - before), deep + (after - place) - 1
    nodes = np.unique(np.stack([first, last, s.shared[deep]], axis=1), axis=0)
    return nodes[:, 0], nodes[:, 1], nodes[:, 2]
