"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is read as lower-cased words in overlapping windows of ``WINDOW`` words,
one beginning every ``STRIDE`` words, until the text is covered.  A word longer
than ``PIECE`` bytes (text without spaces) is read as overlapping pieces.  A
word's input joins a word vector (a hashed learned embedding and the word's
evidence) and a character vector: the mean of the hashed learned embeddings of
all its byte 3-, 4- and 5-grams, its ends marked, and the greatest and the mean
evidence of these.  Evidence is the shrunk log-odds of a feature between toxic
and other training documents; in training a document's own count is left out, so
that it means the same in training and in use.

Two gated recurrent layers read a window forwards and backwards, attention
pools their states, a logistic unit scores the window.  The document's score is
its greatest window's, calibrated on the training documents.  Training is
multiple-instance: a toxic document contributes the window that currently
scores highest, other documents their highest and random ones; the words of a
window are turned round by a random number of places, so that no place in a
window counts more than another.  All of it is numpy.

Training rows are those whose crc32(doc_id as text) mod 3 is not 1, at most
``TOXIC`` and ``OTHER`` of either label, drawn by a hash of doc_id; of these a
text longer than ``LONGEST`` bytes is not learnt from, which bounds the driver's
memory.  Scoring is
one pass over whole texts without a shuffle.

Defined cases: a null or empty text scores 0; repeated rows score alike; a null
doc_id is not held out; without labels of both kinds, or without a word in the training texts, every document scores 0.
Further columns are ignored by :func:`score_documents` and kept by
:func:`keep_clean`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, hash_sample, table
from .quality_pu import fold_of

WINDOW, STRIDE = 64, 32
TOXIC, OTHER = 1500, 2500
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
LONGEST = 1 << 16
STATE = 8
#: Evidence of a word: its own, the greatest and the mean of its n-grams.
KINDS = 3
#: Bytes of the n-grams, and of the pieces of longer words and how far apart these begin.
GRAMS = (3, 4, 5)
PIECE, PIECE_STEP = 24, 16
EVIDENCE_BITS, EMBED_BITS, EMBED = 18, 13, 4
INPUT = KINDS + 2 * EMBED + 1
#: Distinct words whose inputs one worker remembers.
MEMO_WORDS = 150_000
#: An epoch goes over at least so many windows; few documents are taken repeatedly.
LEAST_WINDOWS = 4000
#: Texts taken out of Arrow at a time.
SLICE = 512
#: Windows scored at a time.
BLOCK = 2048

_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    words = text.lower().encode().translate(_WORD_BYTES).split() if text else []
    if len(max(words, key=len, default=b"")) <= PIECE:
        return words
    out = []
    for w in words:
        out += [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE + PIECE_STEP, PIECE_STEP)]
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).astype(np.int64) & 0x7FFFFFFF


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, hashes of all their n-grams word by word, and where each word's n-grams begin."""
    whole = np.fromiter(map(crc32, words), np.int64, len(words))
    data = np.frombuffer(b"<" + b"><".join(words) + b">" + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    n = int(size.sum())
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(n)  # bytes of the word from here on
    value, at, found, of = np.zeros(n, np.uint64), 0, [], []
    for length in GRAMS:
        while at < length:
            value = value | (data[at : at + n] << np.uint64(8 * at))
            at += 1
        on = left >= length
        found.append(_mix(value[on] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(length)))
        of.append(owner[on])
    of_all = np.concatenate(of)
    order = np.argsort(of_all, kind="stable")
    return whole, np.concatenate(found)[order], np.searchsorted(of_all[order], np.arange(len(words)))


def _pooled(grams: np.ndarray, begins: np.ndarray, values: np.ndarray, pool_: np.ufunc = np.add) -> np.ndarray:
    """Sum (or another reduction) of the n-grams' values, word by word."""
    return pool_.reduceat(values[grams], begins, axis=0) if len(begins) else np.zeros((0, *values.shape[1:]), values.dtype)


def _share(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    return (1 / np.diff(np.r_[begins, len(grams)])).astype(np.float32)


def evidence_of(whole: np.ndarray, grams: np.ndarray, begins: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """(n, KINDS) from the table of log-odds; one n-gram is enough to stand out."""
    mask = (1 << EVIDENCE_BITS) - 1
    g = grams & mask
    mean = _pooled(g, begins, table_) * _share(grams, begins)
    return np.stack([table_[whole & mask], _pooled(g, begins, table_, np.maximum), mean], 1).astype(np.float32)


def starts(n: int) -> list[int]:
    """Where the windows of n words begin."""
    return list(range(0, max(1, n - WINDOW + STRIDE), STRIDE)) if n else []


def inputs(model: dict, hashed: tuple, evidence: np.ndarray | None = None) -> np.ndarray:
    """Input vectors of words from their hashes, (n, INPUT)."""
    whole, grams, begins = hashed
    if evidence is None:
        evidence = evidence_of(*hashed, model["evidence"])
    mask = (1 << EMBED_BITS) - 1
    chars = _pooled(grams & mask, begins, model["chars"]) * _share(grams, begins)[:, None]
    return np.concatenate([evidence, model["words"][whole & mask], chars, np.ones((len(whole), 1), np.float32)], 1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction: x (T, B, 3H) holds W x + b for update, reset and candidate; u is (H, 3H)."""
    steps, size, _ = x.shape
    h = np.zeros((size, STATE), np.float32)
    out = np.empty((steps, size, STATE), np.float32)
    for t in range(steps):
        a = h @ u
        gates = 1 / (1 + np.exp(-(x[t, :, : 2 * STATE] + a[:, : 2 * STATE])))
        z, r = gates[:, :STATE], gates[:, STATE:]
        c = np.tanh(x[t, :, 2 * STATE :] + r * a[:, 2 * STATE :])
        if keep is not None:
            keep.append((h, a, z, r, c))
        h = z * h + (1 - z) * c
        out[t] = h
    return out


def _back(grad: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of _run with respect to x and u."""
    steps, size, _ = grad.shape
    dx, du = np.empty((steps, size, 3 * STATE), np.float32), np.zeros_like(u)
    carry = np.zeros((size, STATE), np.float32)
    for t in range(steps - 1, -1, -1):
        h, a, z, r, c = kept[t]
        d = grad[t] + carry
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (h - c) * z * (1 - z)
        dr = dc * a[:, 2 * STATE :] * r * (1 - r)
        da = np.concatenate([dz, dr, dc * r], 1)
        dx[t] = np.concatenate([dz, dr, dc], 1)
        du += h.T @ da
        carry = d * z + da @ u.T
    return dx, du


def pool(model: dict, states: np.ndarray, real: np.ndarray) -> tuple:
    """Attention over the states (T, B, 2H) where real (T, B); the windows' logits."""
    e = np.tanh(states @ model["att"])
    s = e @ model["ask"] * 4
    s = np.where(real, s, -1e9)
    s = np.exp(s - s.max(0))
    weight = s / s.sum(0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ model["out"] + model["bias"][0], pooled, weight, e


def project(model: dict, x: np.ndarray) -> np.ndarray:
    """W x for both directions, (n, INPUT) -> (n, 6H)."""
    return x @ np.concatenate([model["wf"], model["wb"]], 1)


def logits(model: dict, projected: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Logits of windows; index (T, B) are rows of projected, 0 where there is no word."""
    x = projected[index]
    width = 3 * STATE
    forward = _run(x[:, :, :width], model["uf"])
    backward = _run(x[::-1, :, width:], model["ub"])[::-1]
    return pool(model, np.concatenate([forward, backward], 2), index > 0)[0]


def pad_row() -> np.ndarray:
    """Projection of the absent word: update gates shut, so that the state stays."""
    row = np.zeros(6 * STATE, np.float32)
    row[:STATE] = row[3 * STATE : 4 * STATE] = 25
    return row


def _gradient(model: dict, x: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Gradients of the weighted logistic loss; x is (T, B, INPUT)."""
    width = 3 * STATE
    shut = np.where(real, 0, 25).astype(np.float32)[:, :, None]
    pf, pb = x @ model["wf"], x @ model["wb"]
    pf[:, :, :STATE] += shut
    pb[:, :, :STATE] += shut
    kf: list = []
    kb: list = []
    forward = _run(pf, model["uf"], kf)
    backward = _run(pb[::-1], model["ub"], kb)[::-1]
    states = np.concatenate([forward, backward], 2)
    logit, pooled, att, e = pool(model, states, real)
    d = (_sigmoid(logit) - y) * weight / len(y)
    grad = {"out": pooled.T @ d, "bias": np.array([d.sum()], np.float32)}
    dpool = np.outer(d, model["out"])
    datt = np.einsum("bh,tbh->tb", dpool, states)
    ds = att * (datt - (att * datt).sum(0)) * 4
    de = ds[:, :, None] * model["ask"] * (1 - e * e)
    grad["ask"] = np.einsum("tb,tba->a", ds, e)
    grad["att"] = np.einsum("tbh,tba->ha", states, de)
    dstate = att[:, :, None] * dpool + de @ model["att"].T
    dpf, grad["uf"] = _back(dstate[:, :, :STATE], kf, model["uf"])
    dpb, grad["ub"] = _back(dstate[::-1, :, STATE:], kb, model["ub"])
    dpb = dpb[::-1]
    flat = x.reshape(-1, INPUT).T
    grad["wf"], grad["wb"] = flat @ dpf.reshape(-1, width), flat @ dpb.reshape(-1, width)
    grad["x"] = dpf @ model["wf"].T + dpb @ model["wb"].T
    return grad


def new_model(seed: int = 3) -> dict:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s=0.3: rng.normal(0, s, shape).astype(np.float32)
    width = 3 * STATE
    model = {
        "evidence": np.zeros(1 << EVIDENCE_BITS, np.float32),
        "words": draw(1 << EMBED_BITS, EMBED, s=0.02), "chars": draw(1 << EMBED_BITS, EMBED, s=0.02),
        "wf": draw(INPUT, width), "wb": draw(INPUT, width), "uf": draw(STATE, width), "ub": draw(STATE, width),
        "att": draw(2 * STATE, STATE), "ask": draw(STATE), "out": draw(2 * STATE), "bias": np.zeros(1, np.float32),
        "slope": 1.0, "offset": 0.0,
    }
    # the candidate of each state starts as a detector of evidence
    for w in (model["wf"], model["wb"]):
        w[:KINDS, 2 * STATE :] = np.abs(w[:KINDS, 2 * STATE :])
    return model


def _log_odds(toxic: np.ndarray, other: np.ndarray, n_toxic: float, n_other: float) -> np.ndarray:
    """Shrunk log-odds of a feature's document counts."""
    raw = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    n = toxic + other
    return (raw * n / (n + 4)).astype(np.float32)


def train(texts: list[str | None], toxic: list[int], *, epochs: int = 10, seed: int = 3, with_evidence: bool = True) -> dict:
    """Fit on whole documents and their labels; ``with_evidence`` off leaves the network to its embeddings."""
    rng = np.random.default_rng(seed)
    model = new_model(seed)
    mask = (1 << EVIDENCE_BITS) - 1
    y = np.array(toxic, np.float32)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    counts = np.zeros((2, 1 << EVIDENCE_BITS), np.float32)
    docs = []
    memo: dict[bytes, int] = {}
    for text in texts:
        docs.append(np.array([memo.setdefault(w, len(memo)) for w in words_of(text)], np.int64))
    if not memo:
        return {}
    whole, grams, begins = hashed = hashes(list(memo))
    ends = np.r_[begins[1:], len(grams)]
    for own, label in zip(docs, toxic, strict=True):
        if len(own):
            some = np.unique(own)
            size = ends[some] - begins[some]
            at = np.arange(size.sum()) + np.repeat(begins[some] - (np.cumsum(size) - size), size)
            counts[label, np.unique(np.concatenate([whole[some], grams[at]]) & mask)] += 1
    if with_evidence:
        model["evidence"] = _log_odds(counts[1], counts[0], n1, n0)
    left_out = {
        1: evidence_of(*hashed, _log_odds(np.maximum(counts[1] - 1, 0), counts[0], n1 - 1, n0)) * with_evidence,
        0: evidence_of(*hashed, _log_odds(counts[1], np.maximum(counts[0] - 1, 0), n1, n0 - 1)) * with_evidence,
    }
    share = _share(grams, begins)
    embed_mask = (1 << EMBED_BITS) - 1
    spans = [(d, s) for d, own in enumerate(docs) for s in starts(len(own))]
    by_doc: dict[int, list[int]] = {}
    for i, (d, _) in enumerate(spans):
        by_doc.setdefault(d, []).append(i)

    def gather(some: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        index = np.full((WINDOW, len(some)), -1)
        for j, i in enumerate(some):
            d, s = spans[i]
            part = docs[d][s : s + WINDOW]
            index[: len(part), j] = np.roll(part, rng.integers(len(part)))
        kinds = np.array([toxic[spans[i][0]] for i in some])
        real = index >= 0
        words, place = np.unique(np.maximum(index, 0), return_inverse=True)
        place = place.reshape(index.shape)
        size = ends[words] - begins[words]
        first = np.cumsum(size) - size
        picked = grams[np.arange(size.sum()) + np.repeat(begins[words] - first, size)]
        base = inputs(model, (whole[words], picked, first), np.zeros((len(words), KINDS), np.float32))
        x = base[place]
        safe = np.maximum(index, 0)
        x[:, :, :KINDS] = np.where(kinds[None, :, None] > 0, left_out[1][safe], left_out[0][safe])
        return np.where(real[:, :, None], x, 0).astype(np.float32), real, (words, place, picked, size)

    def scores() -> np.ndarray:
        """Logits of all windows, every word projected once for either label in turn."""
        out = np.empty(len(spans), np.float32)
        for label in (0, 1):
            projected = np.empty((len(whole) + 1, 6 * STATE), np.float32)
            projected[0] = pad_row()
            projected[1:] = project(model, inputs(model, hashed, left_out[label]))
            some = [i for i, (d, _) in enumerate(spans) if toxic[d] == label]
            for at in range(0, len(some), BLOCK // 4):  # the driver has other things in memory
                part = some[at : at + BLOCK // 4]
                index = np.zeros((WINDOW, len(part)), np.int64)
                for j, i in enumerate(part):
                    d, s = spans[i]
                    own = docs[d][s : s + WINDOW]
                    index[: len(own), j] = own + 1
                out[part] = logits(model, projected, index)
        return out

    # to begin with, a document's strongest window is the one of most evidence
    strength = np.array([left_out[toxic[d]][docs[d][s : s + WINDOW]].max() for d, s in spans])
    dense = [k for k in model if k not in ("evidence", "words", "chars", "slope", "offset")]
    first, second = {k: np.zeros_like(model[k]) for k in dense}, {k: np.zeros_like(model[k]) for k in dense}
    step, size = 0, 64
    for epoch in range(epochs):
        if epoch in (2, 5):
            strength = scores()
        chosen: list[int] = []
        for d, own in by_doc.items():
            best = own[int(np.argmax(strength[own]))]
            chosen.append(best)
            if not toxic[d] and len(own) > 1:
                chosen.append(own[int(rng.integers(len(own)))])
        chosen = chosen * max(1, math.ceil(LEAST_WINDOWS / len(chosen)))
        labels = np.array([toxic[spans[i][0]] for i in chosen], np.float32)
        up = 0.5 * len(labels) / max(1, labels.sum())
        down = 0.5 * len(labels) / max(1, len(labels) - labels.sum())
        order = rng.permutation(len(chosen))
        for at in range(0, len(order), size):
            some = order[at : at + size]
            x, real, used = gather([chosen[i] for i in some])
            target = labels[some]
            grad = _gradient(model, x, real, target, np.where(target > 0, up, down))
            step += 1
            rate = 0.01 / (1 + epoch / 4)
            for k in dense:
                g = grad[k] + 1e-4 * model[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                model[k] = (model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            words, place, picked, held = used
            to = place[real]
            gx = np.stack([np.bincount(to, grad["x"][:, :, KINDS + k][real], len(words)) for k in range(2 * EMBED)], 1)
            np.add.at(model["words"], whole[words] & embed_mask, (-0.5 * gx[:, :EMBED]).astype(np.float32))
            spread = np.repeat(-0.5 * gx[:, EMBED:] * share[words][:, None], held, axis=0)
            for k in range(EMBED):
                model["chars"][:, k] += np.bincount(picked & embed_mask, spread[:, k], 1 << EMBED_BITS)
    final = scores()
    best = np.array([final[by_doc[d]].max() for d in by_doc])
    truth = np.array([toxic[d] for d in by_doc], np.float64)
    model["slope"], model["offset"] = platt(best.astype(np.float64), truth)
    return model


def platt(values: np.ndarray, labels: np.ndarray, *, steps: int = 300) -> tuple[float, float]:
    """slope >= 0 and offset of a logistic curve, by damped Newton steps."""
    slope, offset, n = 1.0, 0.0, len(values)
    target = np.where(labels > 0, 1 - 1 / (labels.sum() + 2), 1 / (n - labels.sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * values + offset, -30, 30)))
        e, v = p - target, p * (1 - p) + 1e-6
        grad = np.array([(e * values).sum() + 1e-2 * (slope - 1), e.sum()])
        hess = np.array([[(v * values * values).sum() + 1e-2, (v * values).sum()], [(v * values).sum(), v.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        slope, offset = max(0.05, slope - np.clip(step[0], -1, 1)), offset - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-6:
            break
    return float(slope), float(offset)


def fit(docs: DataFrame, labels: DataFrame, *, toxic: int = TOXIC, other: int = OTHER) -> dict:
    """Train on a bounded sample of the labelled training rows that docs holds."""
    learn = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    learn = checkpointed(learn.join(docs.select("doc_id"), "doc_id", "left_semi"))
    known = {}
    for kind, most in ((1, toxic), (0, other)):
        known |= {r.doc_id: kind for r in hash_sample(learn.where(f"toxic = {kind}"), "doc_id", most, 21)}
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in known], "doc_id long")
    found = {r.doc_id: r.text for r in docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST).join(F.broadcast(ids), "doc_id", "left_semi").toLocalIterator()}
    order = sorted(found)
    marks = [known[i] for i in order]
    if len(set(marks)) < 2:
        return {}
    return train([found[i] for i in order], marks)


class Scorer:
    """Scores texts by a trained model; remembers the inputs of frequent words."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.projected = np.zeros((1024, 6 * STATE), np.float32)
        self.projected[0] = pad_row()

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.memo]
        if not new:
            return
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.clear()
            new = list(words)
        base = len(self.memo) + 1
        if base + len(new) > len(self.projected):
            grown = np.empty((max(2 * len(self.projected), base + len(new)), 6 * STATE), np.float32)
            grown[: len(self.projected)] = self.projected
            self.projected = grown
        self.projected[base : base + len(new)] = project(self.model, inputs(self.model, hashes(new)))
        self.memo.update(zip(new, range(base, base + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        if self.model:
            held: list[np.ndarray] = []
            owners: list[int] = []
            width = 0
            for d, text in enumerate(texts):
                words = words_of(text)
                for at in range(0, len(words), 1 << 16):  # a long text in slices that overlap by a window
                    part = words[at : at + (1 << 16) + WINDOW - STRIDE]
                    self._learn(set(part)) if held == [] else self._learn_or_flush(set(part), held, owners, best)
                    n = len(part)
                    index = np.zeros(starts(n)[-1] + WINDOW, np.int32)
                    index[:n] = list(map(self.memo.__getitem__, part))
                    views = np.lib.stride_tricks.sliding_window_view(index, WINDOW)[::STRIDE]
                    held.append(views)
                    owners += [d] * len(views)
                    width += len(views)
                    if width >= BLOCK:
                        self._flush(held, owners, best)
                        width = 0
            self._flush(held, owners, best)
            scored = _sigmoid(self.model["slope"] * best + self.model["offset"])
            return np.where(np.isfinite(best), scored, 0.0)
        return np.zeros(len(texts))

    def _learn_or_flush(self, words: set[bytes], held: list, owners: list, best: np.ndarray) -> None:
        if len(self.memo) + len(words) > MEMO_WORDS:
            self._flush(held, owners, best)
        self._learn(words)

    def _flush(self, held: list, owners: list, best: np.ndarray) -> None:
        if held:
            index = np.concatenate(held)
            at = np.array(owners)
            for k in range(0, len(index), BLOCK):
                some = index[k : k + BLOCK]
                length = int((some > 0).sum(1).max())
                np.maximum.at(best, at[k : k + BLOCK], logits(self.model, self.projected, some.T[:length]))
            held.clear()
            owners.clear()


def _scores(scorer: Scorer, texts: pa.Array) -> np.ndarray:
    """Scores of an Arrow column, a slice of it in Python at a time."""
    parts = [scorer(texts.slice(at, SLICE).to_pylist()) for at in range(0, len(texts), SLICE)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(scorer, batch.column(1)), pa.float64())], ["doc_id", "score"])

    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: dict) -> DataFrame:
    """The documents, all their columns, that score below THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(scorer, batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
