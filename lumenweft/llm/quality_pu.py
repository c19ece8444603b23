"""Quality classifier by positive-unlabelled learning.

Trusted positives are the labelled good documents of the training rows; the
unlabelled web text is a sample of the documents whatever their labels.  Labels
of bad documents are not used at all.  A small network over features of the
whole text is trained in numpy to minimise the non-negative unbiased risk (Kiryo
et al. 2017)

    pi R_p(+) + max(0, R_u(-) - pi R_p(-))

with the logistic loss.  The class prior pi is estimated from the positives and
the unlabelled text by best-bin estimation (Garg et al. 2021): a network tells
the two apart on one half, and of all thresholds on the other half the one with
the least upper bound of q_u / q_p gives pi, q being the shares above it; both
halves take their turn.  The margin is turned into a probability by the slope
and offset that minimise the unbiased risk, -pi mean_p z + mean_u log(1 + e^z),
so calibration needs no labelled negatives either.

Training rows are those whose crc32(doc_id as text) mod 4 is not 2.  At most
``POSITIVES`` and ``UNLABELLED`` rows, drawn by a hash of doc_id, are used; all
documents are scored.  Scoring is one pass without a shuffle.

Defined cases: a null or empty text has the features of no characters and gets
a score like any other; ties and repeated rows score alike; a null doc_id is
not held out; without a labelled good document among the training rows there is
nothing to learn and every document scores 1.  Further columns are ignored by
:func:`score_documents` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, hash_sample, table

POSITIVES = 6000
UNLABELLED = 10000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

_PUNCT = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    """Class of a byte: 0 control, 1 newline, 2 space, 3 digit, 4 lower, 5 upper, 6 sentence mark, 7 other mark, 8 beyond ASCII."""
    kind = np.zeros(256, np.int64)
    kind[128:] = 8
    for chars, k in ((b"\n\r", 1), (b" \t", 2), (b"0123456789", 3), (_PUNCT, 7), (b".,;:'\"-()", 6)):
        kind[list(chars)] = k
    kind[ord("a") : ord("z") + 1] = 4
    kind[ord("A") : ord("Z") + 1] = 5
    return kind


_KIND = _classes().astype(np.uint8)
_MARK = np.full(256, len(_PUNCT), np.uint8)
_MARK[list(_PUNCT)] = np.arange(len(_PUNCT))
WIDTH = 81 + len(_PUNCT) + 12


def features(text: str | None) -> np.ndarray:
    """Shares of byte-class pairs and marks, and repetition of words and lines, over the whole text."""
    text = text or ""
    out = np.zeros(WIDTH, np.float32)
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    if not n:
        return out
    kind = _KIND[data]
    pairs = np.bincount(kind[:-1] * np.uint8(9) + kind[1:], minlength=81)
    out[:81] = np.sqrt(pairs / n)
    out[81 : 81 + len(_PUNCT)] = np.sqrt(np.bincount(_MARK[data], minlength=len(_PUNCT) + 1)[: len(_PUNCT)] / n)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / m
    skip = sum(map(eq, words, words[2:])) / m
    distinct = len(set(words)) / m
    plain = text.count(". ") + text.count(".\n") + text.count(".")
    out[81 + len(_PUNCT) :] = (
        np.log1p(n) / 10, again, np.sqrt(again), skip, distinct, distinct * np.log1p(m) / 5, n / m / 10,
        len(set(lines)) / len(lines), np.log1p(len(lines)) / 5, m / n * 5, plain / m, len(max(words, key=len, default="")) / 50,
    )
    return out


def train_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, *, hidden: int = 24, epochs: int = 60, seed: int = 5) -> dict:
    """Weights of a one-layer network that minimises the non-negative unbiased risk; without a prior it tells the two samples apart."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = ((np.clip((x - mean) / scale, -6, 6)).astype(np.float64) for x in (positive, unlabelled))
    decay = 2 / len(both)  # a prior on the weights, the weaker the more rows there are
    w = {"a": rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], hidden)), "b": np.zeros(hidden), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    t, size = 0, 256
    steps = max(8, len(u) // size)
    for epoch in range(max(epochs, 400 // steps)):
        po, uo = rng.permutation(len(p)), rng.permutation(len(u))
        rate = 0.01 / (1 + epoch / 15)
        for s in range(steps):
            xp = p[po[np.arange(s * size, (s + 1) * size) % len(p)]]
            xu = u[uo[np.arange(s * size, (s + 1) * size) % len(u)]]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ w["a"] + w["b"])
            g = h @ w["c"] + w["d"]
            n = len(xp)
            sig = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
            # logistic loss: l+ = log(1 + e^-g), l- = log(1 + e^g); their slopes are sig - 1 and sig
            low = np.logaddexp(0, g)
            slope = np.zeros(len(x))
            if prior is None:
                slope[:n] = (sig[:n] - 1) / n
                slope[n:] = sig[n:] / (len(x) - n)
            elif low[n:].mean() - prior * low[:n].mean() >= 0:
                slope[:n] = prior * (sig[:n] - 1) / n - prior * sig[:n] / n
                slope[n:] = sig[n:] / (len(x) - n)
            else:  # step back where the estimated negative risk is below what is possible
                slope[:n] = prior * sig[:n] / n
                slope[n:] = -sig[n:] / (len(x) - n)
            back = np.outer(slope, w["c"]) * (1 - h * h)
            grad = {"a": x.T @ back + decay * w["a"], "b": back.sum(0), "c": h.T @ slope + decay * w["c"], "d": np.array([slope.sum()])}
            t += 1
            for k in w:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                w[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return w | {"mean": mean, "scale": scale}


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return np.tanh(z @ model["a"] + model["b"]) @ model["c"] + model["d"][0]


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, *, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The class prior from the scores of two samples that trained nothing."""
    at = np.sort(positive)
    q_p = 1 - np.arange(len(at)) / len(at)
    q_u = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / (2 * len(unlabelled))) + np.sqrt(np.log(4 / delta) / (2 * len(at))))
    best = int(np.argmin((q_u + slack) / q_p))
    return float(q_u[best] / q_p[best])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of good documents in the unlabelled sample, each half judged by a network of the other."""
    found = []
    for k in (0, 1):
        model = train_nnpu(positive[k::2], unlabelled[k::2], None, epochs=20)
        found.append(best_bin(margin(model, positive[1 - k :: 2]), margin(model, unlabelled[1 - k :: 2])))
    return float(np.clip(np.mean(found), 0.01, 0.99))


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, ridge: float = 1e-2, steps: int = 200) -> tuple[float, float]:
    """slope > 0 and offset that minimise the unbiased logistic risk of slope * margin + offset, by damped Newton steps."""
    slope, offset = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * unlabelled + offset, -30, 30)))
        v = p * (1 - p)
        grad = np.array([(p * unlabelled).mean() - prior * positive.mean() + ridge * (slope - 1), p.mean() - prior + ridge * offset])
        hess = np.array([[(v * unlabelled**2).mean(), (v * unlabelled).mean()], [(v * unlabelled).mean(), v.mean()]]) + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        slope, offset = max(0.05, slope - step[0]), offset - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(slope), float(offset)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def _sampled_features(docs: DataFrame, ids: DataFrame) -> dict[int, np.ndarray]:
    """Features of the documents named by ids, a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["doc_id", "x"])

    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    return {r.doc_id: np.frombuffer(r.x, np.float32) for r in some.mapInArrow(run, "doc_id long, x binary").toLocalIterator()}


def train(positive: np.ndarray, unlabelled: np.ndarray) -> dict:
    """Prior, network and calibration from the features of the two samples."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return {"constant": 1.0}
    prior = class_prior(positive, unlabelled)
    model = train_nnpu(positive, unlabelled, prior)
    model["slope"], model["offset"] = calibrate(margin(model, positive), margin(model, unlabelled), prior)
    return model | {"prior": prior}


def fit(docs: DataFrame, labels: DataFrame, *, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> dict:
    """Train on at most the given numbers of rows that docs holds; the model is a dict of small arrays."""
    good = labels.select("doc_id").where(F.col("doc_id").isNotNull() & (F.col("quality") == 1) & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    good = checkpointed(good.join(docs.select("doc_id"), "doc_id", "left_semi"))
    trusted = [r.doc_id for r in hash_sample(good, "doc_id", positives, 11)]
    if not trusted:
        return {"constant": 1.0}
    others = [r.doc_id for r in hash_sample(docs.select("doc_id").where(F.col("doc_id").isNotNull()), "doc_id", unlabelled, 12)]
    ids = docs.sparkSession.createDataFrame([(i,) for i in {*trusted, *others}], "doc_id long")
    x = _sampled_features(docs, ids)
    rows = [np.array([x[i] for i in some if i in x], np.float32).reshape(-1, WIDTH) for some in (trusted, others)]
    return train(*rows)


def score(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), float(model["constant"]))
    return 1 / (1 + np.exp(-np.clip(model["slope"] * margin(model, x) + model["offset"], -40, 40)))


def _scores(model: dict, texts: pa.Array) -> np.ndarray:
    return score(model, np.array([features(t.as_py()) for t in texts], np.float32).reshape(len(texts), WIDTH))


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(shared.value, batch.column(1)), pa.float64())], ["doc_id", "score"])

    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: dict) -> DataFrame:
    """The documents, all their columns, that score THRESHOLD or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
