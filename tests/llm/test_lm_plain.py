"""A document's score by plain loops, and the packed numbers of the blocks."""

import math
import random

import numpy as np

from scholarflow.llm import lm_scoring as L


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(2)
    for top in (1, 127, 128, 129, 1 << 14, 1 << 21, (1 << 28) - 1):
        values = np.concatenate([rng.integers(0, top + 1, 300), [0, top]])
        assert (L.unpacked(L.packed(values)) == values).all()
    assert L.packed(np.zeros(0, np.int64)) == b"" and len(L.unpacked(b"")) == 0
    assert len(L.packed(np.array([127]))) == 1 and len(L.packed(np.array([128]))) == 2


def test_score_by_plain_loops(spark):
    rng = random.Random(1)
    names = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(names, [1 / (i + 1) for i in range(300)], k=rng.randrange(60))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    _, known, params = L.fit(docs)
    scored = {r["doc_id"]: r for r in L.lm_scores(docs).collect()}
    count = {}
    for t in texts:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    raw = {w: L.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0] for w in count}
    group = {w: int(known.classes(h, np.array([count[w]]))[0][0]) for w, h in raw.items()}
    held = {}
    for w, g in group.items():
        held[g] = held.get(g, 0) + count[w]
    # the shares of a class's words add up to one
    assert all(abs(sum(count[w] / held[g] for w in group if group[w] == g) - 1) < 1e-12 for g in held)
    net = L.Network(params, known.size)
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    classes, side = known.size, L.SIDE

    def log_probability(around, target):
        x = [v for t in around for v in p["E"][t]]
        hidden = [math.tanh(sum(x[i] * p["W"][i][j] for i in range(len(x))) + p["b"][j]) for j in range(L.HIDDEN)]
        logit = [sum(hidden[j] * p["O"][j][c] for j in range(L.HIDDEN)) + p["c"][c] for c in range(classes)]
        top = max(logit)
        return logit[target] - top - math.log(sum(math.exp(v - top) for v in logit))

    for i in (0, 7, 33):
        ids = [group[w] for w in texts[i].split()]
        padded = [classes] * side + ids + [classes] * side
        want = 0.0
        for at, w in enumerate(texts[i].split()):
            around = padded[at : at + side] + padded[at + side + 1 : at + 2 * side + 1]
            want += log_probability(around, ids[at]) + math.log(count[w] / held[ids[at]])
        assert scored[i]["n_tokens"] == len(ids) and abs(scored[i]["log_likelihood"] - want) < 1e-2 * max(1, len(ids)) * 0.01 + 1e-3
