"""Suffix order, factors and nodes of a group against plain loops."""

import random

import numpy as np
import pytest

from scholarflow.llm.suffix_dedup import _leading
from scholarflow.llm.suffixes import internal_nodes, longest_previous_factors, next_smaller, previous_smaller, suffixes
from scholarflow.llm.substring_dedup import beyond_first


def common(a, b):
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


def cut(seed, base, depth):
    """Some texts, one after another, and the places where ``depth`` symbols of one text start."""
    rng = random.Random(seed)
    whole, at = [], []
    for _ in range(rng.randint(1, 8)):
        text = [rng.choice([0, 97, 98]) for _ in range(rng.randint(depth, 3 * depth))]
        if rng.random() < 0.3:
            text = [97] * len(text)
        if whole and rng.random() < 0.5:
            text = whole[: 2 * depth] + text
        at += range(len(whole), len(whole) + len(text) - depth + 1)
        whole += text
    data = np.array(whole, np.uint8)
    values = _leading(data) if base == 8 else data.astype(np.uint64)
    return whole, values, np.array(at)


@pytest.mark.parametrize(("base", "depth"), [(1, 5), (1, 12), (1, 50), (8, 9), (8, 30), (8, 80)])
def test_against_loops(base, depth):
    for seed in range(8):
        whole, values, at = cut(seed, base, depth)
        windows = [tuple(whole[p : p + depth]) for p in at]
        s = suffixes(values, base, depth, at)
        assert s.order.tolist() == sorted(range(len(at)), key=lambda i: (windows[i], i))
        ordered = [windows[i] for i in s.order]
        assert s.shared.tolist() == [0] + [common(x, y) for x, y in zip(ordered, ordered[1:])]
        if len(at) < 150:
            before = [max((common(w, v) for v in windows[:i]), default=0) for i, w in enumerate(windows)]
            behind = [max((common(w, v) for v in windows[i + 1 :]), default=0) for i, w in enumerate(windows)]
            assert longest_previous_factors(s).tolist() == before
            assert longest_previous_factors(s, later=True).tolist() == behind
        least = depth // 2
        nodes = set()
        for i, size in enumerate(s.shared.tolist()):
            if size >= least:
                alike = [j for j, w in enumerate(ordered) if w[:size] == ordered[i][:size]]
                nodes.add((alike[0], alike[-1], size))
        assert set(zip(*[x.tolist() for x in internal_nodes(s, least)])) == nodes
        doc = np.array([random.Random(seed + i).randint(0, 3) for i in range(len(at))])
        smallest = {}
        for w, d in zip(windows, doc.tolist()):
            smallest[w] = min(d, smallest.get(w, d))
        assert beyond_first(s, depth, doc).tolist() == [d > smallest[w] for w, d in zip(windows, doc.tolist())]


def test_smaller_neighbours():
    for seed in range(30):
        rng = random.Random(seed)
        x = np.array([rng.randint(0, 9) for _ in range(rng.randint(1, 60))])
        if seed % 3 == 0:
            x = np.sort(x) if seed % 2 else -np.sort(x)
        shared = np.array([rng.randint(0, 9) for _ in x])
        before, least = previous_smaller(x, shared)
        after, behind = next_smaller(x, shared)
        for i in range(len(x)):
            left = [j for j in range(i) if x[j] < x[i]]
            right = [j for j in range(i + 1, len(x)) if x[j] < x[i]]
            assert before[i] == (left[-1] if left else -1)
            assert after[i] == (right[0] if right else len(x))
            if left:
                assert least[i] == shared[left[-1] + 1 : i + 1].min()
            if right:
                assert behind[i] == shared[i + 1 : right[0] + 1].min()


def test_nothing_to_order():
    s = suffixes(np.zeros(0, np.uint64), 1, 5, np.zeros(0, np.int64))
    assert longest_previous_factors(s).tolist() == []
    assert [x.tolist() for x in internal_nodes(s, 1)] == [[], [], []]
