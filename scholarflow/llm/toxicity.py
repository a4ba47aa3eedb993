"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of what its spelling says (the mean of the vectors of
its character n-grams) and what it is (a vector of its own, if the training
sample had it often enough). Two gated recurrent layers read a window of words
from left and right, attention pools their states, and a linear unit gives the
window's logit. All windows of a text, each half over the one before, are scored;
the text's score is a logistic function of its best window, of how many windows
look toxic, and of how many there are.

Network and gradients are numpy. It is trained on a bounded sample of labelled
documents: first every window has its document's label, then windows of toxic
documents that the network finds harmless count as harmless.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_values, mix, prefix_hashes, ragged, slices, span_hashes, text_crc

# the training sample: about so many documents of each label, windows of each
TOXIC_DOCS, CLEAN_DOCS, WINDOWS_PER_DOC = 600, 1800, 32
LENGTH, STRIDE = 16, 8
HIDDEN, SIZE, ATTENTION = 8, 12, 8
# three phases, each at least one pass and at least so many steps
PHASES, STEPS, BATCH, RATE = 3, 200, 256, 0.01
MIN_DOCS = 10
CACHE_BITS, SOME_WORDS = 17, 1 << 14
REPEATED = 0.15
THRESHOLD = 0.7

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_EDGE = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the accented Latin-1 letters in UTF-8."""
    out = LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[upper] += 32
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters and digits: (starts, ends, first word of each text)."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = _WORD_BYTE[data]
    begin, last = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    begin[heads], last[tails] = inside[heads], inside[tails]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _grams(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's character n-grams, and the word of each.

    Beginnings of 2 to 8 bytes, endings of 2 to 4 bytes and all triplets.
    """
    size, word = ends - starts, np.arange(len(starts))
    out, owner = [], []
    for kind, n in enumerate(range(2, 9)):
        w = word[size >= n]
        out.append(span_hashes(prefix, starts[w], starts[w] + n) ^ _EDGE[kind])
        owner.append(w)
    for kind, n in enumerate(range(2, 5), 8):
        w = word[size >= n]
        out.append(span_hashes(prefix, ends[w] - n, ends[w]) ^ _EDGE[kind])
        owner.append(w)
    inner = np.maximum(size - 2, 0)
    at = ragged(starts, inner)
    out.append(span_hashes(prefix, at, at + 3) ^ _EDGE[12])
    owner.append(np.repeat(word, inner))
    return np.concatenate(out), np.concatenate(owner).astype(np.int32)


@dataclass
class Texts:
    """Words of some texts: the distinct words and where each is spelled."""

    first: np.ndarray  # of each text, its first word
    word: np.ndarray  # of each word, its distinct word
    hashes: np.ndarray  # of each distinct word
    prefix: np.ndarray  # of the bytes, for hashes of n-grams
    starts: np.ndarray  # of each distinct word, its bytes
    ends: np.ndarray

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of some distinct words, and the place in ``which`` of each."""
        return _grams(self.prefix, self.starts[which], self.ends[which])

    def some(self) -> Iterator[np.ndarray]:
        """All distinct words, in runs that keep their n-grams few."""
        for i in range(0, len(self.hashes), SOME_WORDS):
            yield np.arange(i, min(i + SOME_WORDS, len(self.hashes)))


def read(data: np.ndarray, offsets: np.ndarray) -> Texts:
    data = _lowered(data)
    starts, ends, first = _words(data, offsets)
    prefix = prefix_hashes(byte_values(data))
    hashes, at, word = np.unique(span_hashes(prefix, starts, ends), return_index=True, return_inverse=True)
    return Texts(first, word, hashes, prefix, starts[at], ends[at])


class Table:
    """Places of keys in a sorted array of hashes, found by their leading bits."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        shift = np.uint64(64 - self.BITS)
        self.first = np.searchsorted(keys >> shift, np.arange(1 << self.BITS, dtype=np.uint64))
        self.most = int(np.diff(self.first, append=len(keys)).max()) if len(keys) else 0

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Place plus one; 0 for absent keys."""
        out = np.zeros(len(keys), np.int64)
        if len(self.keys):
            place = self.first[(keys >> np.uint64(64 - self.BITS)).astype(np.int64)]
            for _ in range(self.most):
                held = np.minimum(place, len(self.keys) - 1)
                np.copyto(out, held + 1, where=self.keys[held] == keys)
                place += 1
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of all windows, as (windows, LENGTH) places, -1 beyond the text,
    and the text of each window; a text without words has one empty window."""
    n = np.diff(first)
    count = np.maximum(-(-(n - LENGTH) // STRIDE), 0) + 1
    text = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][text] + ragged(np.zeros(len(n), np.int64), count) * STRIDE
    place = begin[:, None] + np.arange(LENGTH)
    return np.where(place < first[1:][text][:, None], place, -1), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Vocabularies (sorted hashes) and parameters."""

    words: np.ndarray
    grams: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)
    scale: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __post_init__(self) -> None:
        self.word_place, self.gram_place = Table(self.words), Table(self.grams)
        # words seen last, by their leading bits, and what they are to the two layers
        self.seen = np.zeros(1 << CACHE_BITS, np.uint64)
        self.seen_rows = np.zeros((1 << CACHE_BITS, 6 * HIDDEN), np.float32)

    def __getstate__(self) -> dict:
        return {"words": self.words, "grams": self.grams, "p": self.p, "scale": self.scale}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def start(self, rng: np.random.Generator) -> None:
        def normal(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {
            "word": 0.1 * rng.standard_normal((len(self.words) + 1, SIZE)).astype(np.float32),
            "gram": 0.1 * rng.standard_normal((len(self.grams) + 1, SIZE)).astype(np.float32),
            "Wf": normal(2 * SIZE, 3 * HIDDEN), "Uf": normal(HIDDEN, 3 * HIDDEN), "bf": np.zeros(3 * HIDDEN, np.float32),
            "Wb": normal(2 * SIZE, 3 * HIDDEN), "Ub": normal(HIDDEN, 3 * HIDDEN), "bb": np.zeros(3 * HIDDEN, np.float32),
            "A": normal(2 * HIDDEN, ATTENTION), "a": np.zeros(ATTENTION, np.float32), "v": normal(ATTENTION),
            "o": normal(2 * HIDDEN), "c": np.zeros(1, np.float32),
        }
        self.p["word"][0] = self.p["gram"][0] = 0

    def inputs(self, t: Texts, which: np.ndarray) -> dict[str, np.ndarray]:
        """What some distinct words are to the network: rows of the two tables."""
        grams, owner = t.grams(which)
        gram = self.gram_place(grams)
        known = gram > 0
        owner = owner[known]
        return {
            "word": self.word_place(t.hashes[which]), "gram": gram[known], "owner": owner,
            "count": np.maximum(np.bincount(owner, minlength=len(which)), 1).astype(np.float32)[:, None],
        }

    def vectors(self, x: dict[str, np.ndarray]) -> np.ndarray:
        p, n = self.p, len(x["word"])
        spelling = np.zeros((n, SIZE), np.float32)
        if len(x["gram"]):
            vector = p["gram"][x["gram"]]
            for k in range(SIZE):
                spelling[:, k] = np.bincount(x["owner"], vector[:, k], n)
        return np.concatenate([p["word"][x["word"]], spelling / x["count"]], axis=1)

    def layer_inputs(self, vectors: np.ndarray) -> np.ndarray:
        """What words add to the gates of the two layers."""
        p = self.p
        return np.concatenate([vectors @ p["Wf"] + p["bf"], vectors @ p["Wb"] + p["bb"]], axis=1)

    def gates(self, t: Texts, which: np.ndarray) -> np.ndarray:
        """``layer_inputs`` of some distinct words."""
        out = np.zeros((len(which), 6 * HIDDEN), np.float32)
        for i in range(0, len(which), SOME_WORDS):
            out[i : i + SOME_WORDS] = self.layer_inputs(self.vectors(self.inputs(t, which[i : i + SOME_WORDS])))
        return out

    def remembered_gates(self, t: Texts) -> np.ndarray:
        """``gates`` of all distinct words, computed for those not seen of late."""
        slot = (t.hashes >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        fresh = np.flatnonzero(self.seen[slot] != t.hashes)
        out = self.seen_rows[slot]
        out[fresh] = self.gates(t, fresh)
        self.seen[slot[fresh]], self.seen_rows[slot[fresh]] = t.hashes[fresh], out[fresh]
        return out

    def forward(self, gates: np.ndarray, place: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows, given as rows of ``gates``, the layers' inputs (-1: none)."""
        p, H = self.p, HIDDEN
        n, length = place.shape
        there = (place >= 0).astype(np.float32).T[:, :, None]
        rows = np.where(place >= 0, place, 0).T
        states = np.empty((length, n, 2 * H), np.float32)
        steps: dict[str, list] = {"f": [None] * length, "b": [None] * length}
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            table = np.ascontiguousarray(gates[:, : 3 * H] if d == "f" else gates[:, 3 * H :])
            h = np.zeros((n, H), np.float32)
            for t in order:
                gx, gh = table[rows[t]], h @ p[f"U{d}"]
                gate = _sigmoid(gx[:, : 2 * H] + gh[:, : 2 * H])
                r, z = gate[:, :H], gate[:, H:]
                new = np.tanh(gx[:, 2 * H :] + r * gh[:, 2 * H :])
                keep = there[t] * (1 - z)
                if trace is not None:
                    steps[d][t] = (h, r, z, new, gh[:, 2 * H :])
                h = h + keep * (new - h)
                if d == "f":
                    states[t, :, :H] = h
                else:
                    states[t, :, H:] = h
        u = np.tanh(states @ p["A"] + p["a"])
        score = u @ p["v"] - 1e9 * (1 - there[:, :, 0])
        weight = np.exp(score - score.max(0)) * there[:, :, 0]
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(0)
        if trace is not None:
            trace |= {"there": there, "rows": rows, "states": states, "steps": steps, "u": u, "weight": weight, "pooled": pooled}
        return pooled @ p["o"] + p["c"][0]

    def gradients(self, x: dict[str, np.ndarray], place: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Weighted cross-entropy of windows and its gradients."""
        p, H, n = self.p, HIDDEN, len(place)
        vectors, tr = self.vectors(x), {}
        logit = self.forward(self.layer_inputs(vectors), place, tr)
        prob = _sigmoid(logit)
        loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum() / n)
        g: dict[str, np.ndarray] = {}
        dz = (weight * (prob - target) / n).astype(np.float32)
        g["o"], g["c"] = tr["pooled"].T @ dz, np.array([dz.sum()], np.float32)
        dpool = dz[:, None] * p["o"]
        states, alpha, u = tr["states"], tr["weight"], tr["u"]
        dalpha = (states * dpool).sum(2)
        dscore = alpha * (dalpha - (alpha * dalpha).sum(0))
        du = dscore[:, :, None] * p["v"] * (1 - u * u)
        g["v"] = np.einsum("tn,tna->a", dscore, u)
        g["A"], g["a"] = np.einsum("tnh,tna->ha", states, du), du.sum((0, 1))
        dstates = alpha[:, :, None] * dpool + du @ p["A"].T
        dvectors = np.zeros_like(vectors)
        length = place.shape[1]
        for d, order in (("f", range(length - 1, -1, -1)), ("b", range(length))):
            dtable = np.zeros((len(vectors), 3 * H), np.float32)
            dU, dh = np.zeros_like(p[f"U{d}"]), np.zeros((n, H), np.float32)
            for t in order:
                h, r, z, new, ghn = tr["steps"][d][t]
                dh = dh + (dstates[t, :, :H] if d == "f" else dstates[t, :, H:])
                keep = tr["there"][t]
                dnew = dh * keep * (1 - z) * (1 - new * new)
                dzg = -dh * keep * (new - h) * z * (1 - z)
                drg = dnew * ghn * r * (1 - r)
                dgh = np.concatenate([drg, dzg, dnew * r], axis=1)
                dgx = np.concatenate([drg, dzg, dnew], axis=1)
                np.add.at(dtable, tr["rows"][t], dgx)
                dU += h.T @ dgh
                dh = dh * (1 - keep * (1 - z)) + dgh @ p[f"U{d}"].T
            g[f"W{d}"], g[f"U{d}"], g[f"b{d}"] = vectors.T @ dtable, dU, dtable.sum(0)
            dvectors += dtable @ p[f"W{d}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], x["word"], dvectors[:, :SIZE])
        spelling = dvectors[:, SIZE:] / x["count"]
        np.add.at(g["gram"], x["gram"], spelling[x["owner"]])
        g["word"][0] = g["gram"][0] = 0
        return loss, g

    def logits(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The logit of every window, and the text of each."""
        place, text = windows(t.first)
        gates = self.remembered_gates(t) if len(t.hashes) else np.zeros((1, 6 * HIDDEN), np.float32)
        rows = np.where(place >= 0, t.word[place] if len(t.word) else 0, -1)
        out = [self.forward(gates, rows[i : i + 8192]) for i in range(0, len(rows), 8192)]
        return np.concatenate(out), text

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: its best window's logit, how many windows look toxic, how many there are, 1."""
        logit, text = self.logits(read(data, offsets))
        n = len(offsets) - 1
        first = np.searchsorted(text, np.arange(n))
        best = np.maximum.reduceat(logit, first)
        toxic = np.add.reduceat(_sigmoid(logit.astype(np.float64)), first)
        count = np.bincount(text, minlength=n)
        return np.stack([best, np.log(toxic + 0.02), np.log(count), np.ones(n)], axis=1).astype(np.float64)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The score of each text, from 0 to 1."""
        return _sigmoid(self.features(data, offsets) @ self.scale)


def _joined(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of texts of about ``limit`` bytes, as bytes and offsets."""
    first = 0
    while first < len(texts):
        end, size = first + 1, len(texts[first])
        while end < len(texts) and size + len(texts[end]) <= limit:
            size += len(texts[end])
            end += 1
        run = texts[first:end]
        yield np.frombuffer(b"".join(run), np.uint8), np.cumsum([0, *map(len, run)])
        first = end


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.step = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.s = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.step += 1
        fix = np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.s[k] += 0.001 * (g[k] * g[k] - self.s[k])
            p[k] -= self.rate * fix * self.m[k] / (np.sqrt(self.s[k]) + 1e-7)


def _batches(net: Network, t: Texts, rows: np.ndarray, target: np.ndarray, weight: np.ndarray, rng, adam: _Adam) -> None:
    """One pass of gradient steps over the windows ``rows``."""
    gram, word, bounds = _spelled(net, t)
    order = rng.permutation(len(rows))
    for i in range(0, len(order), BATCH):
        pick = order[i : i + BATCH]
        used, local = np.unique(rows[pick], return_inverse=True)
        local = local.reshape(len(pick), -1)
        shift = int(used[0] == -1)
        used = used[shift:] if len(used) > shift else np.zeros(1, np.int64)
        size = bounds[used + 1] - bounds[used]
        part = {
            "word": word[used], "gram": gram[ragged(bounds[used], size)],
            "owner": np.repeat(np.arange(len(used)), size), "count": np.maximum(size, 1).astype(np.float32)[:, None],
        }
        adam.update(net.p, net.gradients(part, local - shift, target[pick], weight[pick])[1])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, with a ridge on all but the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        prob = _sigmoid(x @ w)
        hessian = (x * (prob * (1 - prob))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (prob - y) + penalty @ w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _spelled(net: Network, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the n-gram table, word by word; rows of the word table; bounds of the first."""
    gram, size, word = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
    for which in t.some():
        x = net.inputs(t, which)
        gram.append(x["gram"][np.argsort(x["owner"], kind="stable")].astype(np.int32))
        size.append(np.bincount(x["owner"], minlength=len(which)))
        word.append(x["word"])
    return np.concatenate(gram), np.concatenate(word), np.cumsum(np.concatenate(size))


def _vocabulary(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Words that are in MIN_DOCS texts at least, and n-grams whose words are."""
    n = len(t.hashes)
    text = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    often = np.bincount(np.unique(text * n + t.word) % max(n, 1), minlength=n)
    grams, spread = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for which in t.some():
        gram, owner = t.grams(which)
        kinds, at = np.unique(gram, return_inverse=True)
        grams.append(kinds)
        spread.append(np.bincount(at, often[which][owner], len(kinds)).astype(np.int64))
    kinds, at = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(at, np.concatenate(spread), len(kinds))
    return t.hashes[often >= MIN_DOCS], kinds[total >= MIN_DOCS]


def _chosen(rows: np.ndarray, text: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Up to WINDOWS_PER_DOC different windows of each text, and the text of each."""
    order = np.lexsort((rng.random(len(text)), text))
    at = np.arange(len(text)) - np.searchsorted(text, text)
    pick = np.sort(order[at < WINDOWS_PER_DOC])
    kinds = np.unique(np.concatenate([text[pick, None], rows[pick]], axis=1), axis=0)
    return kinds[:, 1:], kinds[:, 0]


def train(texts: list[bytes], labels: list[int], seed: int = 7) -> Network:
    """A network from labelled texts."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, np.float64)
    t = read(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    net = Network(*_vocabulary(t))
    net.start(rng)
    place, text = windows(t.first)
    rows = np.where(place >= 0, t.word[place] if len(t.word) else 0, -1)
    rows, owner = _chosen(rows, text, rng)
    # one word over and over means no more than the word: such windows of clean texts are clean
    clean = np.flatnonzero((y[owner] == 0) & (rows[:, 0] >= 0))
    clean = clean[rng.random(len(clean)) < REPEATED]
    rows = np.concatenate([rows, np.repeat(rows[clean, :1], LENGTH, axis=1)])
    owner = np.concatenate([owner, owner[clean]])
    target = y[owner]
    adam = _Adam(net.p, RATE)
    passes = max(1, -(-STEPS * BATCH // max(len(rows), 1)))
    for phase in range(PHASES):
        share = max(target.mean(), 1e-3)
        weight = np.where(target > 0, min(0.5 / share, 4.0), 1.0)
        adam.rate = RATE / (1 + phase)
        for _ in range(passes):
            _batches(net, t, rows, target.astype(np.float32), weight.astype(np.float32), rng, adam)
        if phase < PHASES - 1 and target.any():
            gates = net.gates(t, np.arange(len(t.hashes)))
            logit = np.concatenate([net.forward(gates, rows[i : i + 8192]) for i in range(0, len(rows), 8192)])
            # a window of a toxic document is toxic if the clean ones' windows rarely look so
            bar = np.quantile(logit[y[owner] == 0], 0.998) if (y == 0).any() else 0.0
            target = ((y[owner] > 0) & (logit > bar)).astype(np.float64)
    del t, rows
    net.seen[:] = 0  # the parameters have changed
    net.scale = _logistic(np.concatenate([net.features(*run) for run in _joined(texts)]), y)
    return net


def sample(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[bytes], list[int]]:
    """The bounded training sample: whole texts, chosen by a hash of the id."""
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & learn).distinct()
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {1: TOXIC_DOCS, 0: CLEAN_DOCS}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    keep = F.lit(False)
    for label, n in counts.items():
        keep = keep | ((F.col("toxic") == label) & (draw < wanted[label] / n))
    chosen = marked.where(keep).limit(2 * (TOXIC_DOCS + CLEAN_DOCS))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.col("text").isNotNull()).select(
        "doc_id", "toxic", F.encode("text", "UTF-8").alias("bytes")
    ).collect()
    rows = sorted((r["doc_id"], bytes(r["bytes"]), r["toxic"]) for r in rows)
    return [r[1] for r in rows], [r[2] for r in rows]


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id and score of every row; whole texts, all windows."""
    given = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in slices(batch, "text", 1 << 20):
                if trained is not None:
                    out[lo:hi] = trained.scores(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], names=["doc_id", "score"])

    return given.mapInArrow(compute, given.select("doc_id").schema.add("score", "double"))


def toxicity(docs: DataFrame, labels: DataFrame, *, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from the labels of rows whose crc32 of the id, modulo ``folds``, is not
    ``held``; labels other than 0 and 1, NULL ones among them, teach nothing, and
    a document with both labels counts once with each. Scores depend on the text
    alone. NULL and empty texts get the score of a text without words. Without
    labels of both kinds every score is 0. Repeated rows are scored one by one.
    """
    remainder = F.pmod(text_crc("doc_id"), F.lit(folds))
    texts, known = sample(docs, labels, remainder != held)
    net = train(texts, known) if len(set(known)) == 2 else None
    out = score(docs, net)
    return out.select(
        "doc_id", (F.pmod(text_crc("doc_id"), F.lit(folds)) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
