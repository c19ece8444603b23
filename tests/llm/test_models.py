"""The quality classifier and the toxicity network: held-out accuracy, gradients, edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

from lumenweft.llm import quality_pu, toxicity

SF = "/root/testdata/sf0.01"


def auc(scores, truth):
    good, bad = scores[truth == 1], scores[truth == 0]
    return ((good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2) if len(good) and len(bad) else 1.0


def held_out(spark, name, folds, fold, column):
    from lumenweft.llm.registry import queries

    got = {r.doc_id: r for r in queries()[name](spark, SF).collect()}
    labels = {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % folds == fold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    some = [i for i in labels if i in got and got[i].held_out]
    return np.array([got[i].score for i in some]), np.array([labels[i] for i in some])


def test_quality_held_out(spark):
    scores, truth = held_out(spark, "op8_quality_pu", 4, 2, "quality")
    assert auc(scores, truth) > 0.97 and ((scores >= 0.7) == truth).mean() > 0.95


def test_toxicity_held_out(spark):
    scores, truth = held_out(spark, "op5_toxicity_bigru", 3, 1, "toxic")
    assert auc(scores, truth) > 0.9 and ((scores >= 0.7) == truth).mean() > 0.93


def test_nnpu_without_negatives():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(1, 1, (2000, 4)), rng.normal(-1.5, 1, (600, 4))
    model = quality_pu.train_nnpu(good[:800].astype(np.float32), np.concatenate([good[800:], bad]).astype(np.float32), 2 / 3)
    m = quality_pu.margin(model, np.concatenate([good, bad]))
    assert auc(m, np.r_[np.ones(2000), np.zeros(600)]) > 0.97
    assert ((m > 0) == np.r_[np.ones(2000), np.zeros(600)].astype(bool)).mean() > 0.9


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (5000, 6)), rng.normal(-1, 1, (4000, 6))
    n = 4000
    unlabelled = np.concatenate([good[1000 : 1000 + int(n * prior)], bad[: n - int(n * prior)]])
    positive, unlabelled = (x.astype(np.float32) for x in (good[:1000], unlabelled))
    assert abs(quality_pu.class_prior(positive, unlabelled) - prior) < 0.08
    model = quality_pu.train(positive, unlabelled)
    p = quality_pu.score(model, unlabelled)
    assert abs(p.mean() - prior) < 0.1  # calibrated as a whole, without one labelled negative


def test_labels_of_bad_documents_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = (quality_pu.fit(docs, some) for some in (labels, labels.where("quality = 1")))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def plain_quality(model, text):
    """The score of one text, each feature counted by itself."""
    import string

    data = (text or "").encode()
    marks = string.punctuation.encode()
    kinds = {9: 2, 32: 2, 10: 1, 13: 1} | {c: 3 for c in b"0123456789"} | {c: 7 for c in marks} | {c: 6 for c in b".,;:'\"-()"} | {c: 4 for c in range(97, 123)} | {c: 5 for c in range(65, 91)}
    kind = [8 if c >= 128 else kinds.get(c, 0) for c in data]
    x = np.zeros(quality_pu.WIDTH)
    if data:
        for a, b in zip(kind, kind[1:]):
            x[a * 9 + b] += 1
        for c in data:
            if c in marks:
                x[81 + marks.index(c)] += 1
        x = np.sqrt(x / len(data))
        words, lines = text.split(), text.split("\n")
        m = max(1, len(words))
        again = sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / m
        skip = sum(words[i] == words[i + 2] for i in range(len(words) - 2)) / m
        distinct = len(set(words)) / m
        plain = text.count(". ") + text.count(".\n") + text.count(".")
        x[-12:] = [math.log1p(len(data)) / 10, again, math.sqrt(again), skip, distinct, distinct * math.log1p(m) / 5, len(data) / m / 10, len(set(lines)) / len(lines), math.log1p(len(lines)) / 5, m / len(data) * 5, plain / m, max(map(len, words), default=0) / 50]
    z = [min(6, max(-6, (v - mean) / scale)) for v, mean, scale in zip(x, model["mean"], model["scale"])]
    hidden = [math.tanh(sum(z[i] * model["a"][i, j] for i in range(len(z))) + model["b"][j]) for j in range(len(model["b"]))]
    g = sum(h * c for h, c in zip(hidden, model["c"])) + model["d"][0]
    return 1 / (1 + math.exp(-max(-40, min(40, model["slope"] * g + model["offset"]))))


def plain_toxicity(model, text):
    """The score of one text: one window, one word and one step after another."""
    import re

    lower = (text or "").lower()
    words = []
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", lower.encode()):
        at = 0
        while len(w) > 24 and at + 24 < len(w):
            words.append(w[at : at + 24])
            at += 16
        words.append(w[at : at + 24])
    if not words:
        return 0.0
    h, known = 8, {}

    def vector(w):
        if w not in known:
            known[w] = toxicity.inputs(model, toxicity.hashes([w]))[0].astype(float)
        return known[w]

    def run(xs, w, u):
        state, out = np.zeros(h), []
        for x in xs:
            a, b = x @ w, state @ u
            z, r = (1 / (1 + np.exp(-(a[i * h : i * h + h] + b[i * h : i * h + h]))) for i in (0, 1))
            state = z * state + (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :])
            out.append(state)
        return out

    best = -np.inf
    for begin in range(0, max(1, len(words) - 32), 32):
        xs = [vector(w) for w in words[begin : begin + 64]]
        states = [np.concatenate(p) for p in zip(run(xs, model["wf"], model["uf"]), run(xs[::-1], model["wb"], model["ub"])[::-1])]
        ask = np.array([np.tanh(s @ model["att"]) @ model["ask"] * 4 for s in states])
        weight = np.exp(ask - ask.max())
        best = max(best, float((weight / weight.sum()) @ np.array(states) @ model["out"] + model["bias"][0]))
    return 1 / (1 + math.exp(-max(-30, min(30, model["slope"] * best + model["offset"]))))


def test_queries_against_plain_networks(spark):
    sf = "/root/testdata/sf0.001"
    from lumenweft.llm.registry import queries

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, module, plain in (("op8_quality_pu", quality_pu, plain_quality), ("op5_toxicity_bigru", toxicity, plain_toxicity)):
        model = module.fit(docs, labels)
        got = {r.doc_id: r.score for r in queries()[name](spark, sf).collect()}
        assert set(got) == set(texts)
        for i, text in texts.items():
            assert abs(got[i] - plain(model, text)) < 2e-3, (name, i)


def test_all_ngrams_of_a_word_count():
    whole, grams, begins = toxicity.hashes([b"ab", b"x", b"abcde"])
    assert np.diff(np.r_[begins, len(grams)]).tolist() == [3, 1, 5 + 4 + 3]
    assert len(set(grams.tolist())) == len(grams) - 1  # "<ab" begins two of the words
    alone = toxicity.hashes([b"abcde"])
    assert alone[1].tolist() == grams[begins[2] :].tolist() and alone[0][0] == whole[2]
    assert toxicity.words_of("Ab " + "x" * 50) == [b"ab", b"x" * 24, b"x" * 24, b"x" * 18]
    assert b"".join(toxicity.words_of("y" * 24)) == b"y" * 24


def test_a_stem_within_unseen_words_and_without_spaces():
    rng = random.Random(4)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]
    bad = ["zorkish", "kwumphole", "wexling"]
    shape = lambda w: rng.choice(["", "un", "re", "over"]) + w + rng.choice(["", "s", "ed", "ness"])
    text = lambda toxic: " ".join([rng.choice(words) for _ in range(60)] + [shape(rng.choice(bad)) for _ in range(2 * toxic)])
    train = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    score = toxicity.Scorer(toxicity.train([t for t, _ in train], [y for _, y in train]))
    plain = [rng.choice(words) for _ in range(60)]
    compound, unspaced = [*plain, "ilozorkisharo"], "".join(plain[:30]) + "kwumphole" + "".join(plain[30:])
    got = score([" ".join(plain), "".join(plain), " ".join(compound), unspaced])
    assert (got[:2] < 0.3).all() and got[2] > 0.7 and got[3] > 3 * got[1], got


def small(spark, texts, labels):
    docs = spark.createDataFrame([(i, t, "a", 0.5) for i, t in enumerate(texts)], "doc_id long, text string, x string, score double")
    marks = spark.createDataFrame([(i, q, q) for i, q in labels], "doc_id long, quality int, toxic int")
    return docs, marks


def test_models_without_labels_of_both_kinds(spark):
    docs, marks = small(spark, ["", None, "a b", "a b"], [(0, 1), (1, None), (None, 0), (2, 5)])
    for labels in (marks, marks.limit(0)):
        q = quality_pu.score_documents(docs, quality_pu.fit(docs, labels)).collect()
        assert len(q) == 4 and all(0 <= r.score <= 1 for r in q)
        t = toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()
        assert [r.score for r in t] == [0.0] * 4
        assert quality_pu.keep_good(docs, quality_pu.fit(docs, labels)).columns == docs.columns
        assert toxicity.keep_clean(docs, {}).count() == 4
    assert quality_pu.score_documents(docs.limit(0), quality_pu.fit(docs.limit(0), marks)).count() == 0


def test_samples_are_drawn_from_the_documents_at_hand(spark):
    """Thousands of labels for documents that an earlier stage rejected do not use up the sample."""
    texts = [("zorkish grumphole plain " if i % 2 else "calm quiet plain ") * 5 for i in range(60)]
    docs, _ = small(spark, texts, [])
    marks = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(6000)], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, marks, toxic=12, other=12)).collect()}
    assert min(s for i, s in scores.items() if i % 2) > 0.7 > max(s for i, s in scores.items() if i % 2 == 0)
    assert "constant" not in quality_pu.fit(docs, marks, positives=12, unlabelled=40)


def test_network_gradients():
    rng = np.random.default_rng(7)
    model = {k: (v.astype(np.float64) if isinstance(v, np.ndarray) else v) for k, v in toxicity.new_model(1).items()}
    x = rng.normal(0, 1, (6, 3, toxicity.INPUT))
    real = np.ones((6, 3), bool)
    real[4:, 1] = False
    x[~real] = 0
    y, weight = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss(m):
        shut = np.where(real, 0, 25)[:, :, None]
        pf, pb = x @ m["wf"], x @ m["wb"]
        pf[:, :, : toxicity.STATE] += shut
        pb[:, :, : toxicity.STATE] += shut
        f, b = toxicity._run(pf, m["uf"]), toxicity._run(pb[::-1], m["ub"])[::-1]
        logit = toxicity.pool(m, np.concatenate([f, b], 2), real)[0]
        return (weight * (np.logaddexp(0, logit) - y * logit)).mean()

    grad = toxicity._gradient(model, x, real, y, weight)
    for k in ("wf", "wb", "uf", "ub", "att", "ask", "out", "bias"):
        at = tuple(rng.integers(n) for n in model[k].shape)
        step = 3e-3
        up, down = ({**model, k: model[k].copy()} for _ in range(2))
        up[k][at] += step
        down[k][at] -= step
        assert abs((loss(up) - loss(down)) / (2 * step) - grad[k][at]) < 2e-3 + 0.02 * abs(grad[k][at]), k


def test_toxic_words_anywhere_in_long_texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(5)) for _ in range(400)]
    bad = ["zorkish", "grumphole", "wexling"]
    text = lambda n, toxic: " ".join(rng.choice(words) if not toxic or rng.random() > 3 / n else rng.choice(bad) for _ in range(n))
    train = [(text(80, k % 3 == 0) + (" zorkish" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(240)]
    model = toxicity.train([t for t, _ in train], [y for _, y in train])
    score = toxicity.Scorer(model)
    clean = text(30000, False)
    spots = [0, 31, 63, 64, 12345, 29999]
    planted = []
    for s in spots:
        w = clean.split()
        w[s] = "grumphole"
        planted.append(" ".join(w))
    got = score([clean, *planted, "", None, "wexling"])
    assert got[0] < 0.3 and (got[1:7] > 0.7).all() and got[7] == got[8] == 0 and got[9] > 0.7


def test_every_window_is_scored():
    for n in (1, 31, 63, 64, 65, 96, 97, 1000):
        covered = set()
        for s in toxicity.starts(n):
            covered |= set(range(s, s + toxicity.WINDOW))
        assert set(range(n)) <= covered
    assert toxicity.starts(0) == []


def test_hash_sample_is_the_least_hashes(spark):
    from pyspark.sql import functions as F

    from lumenweft.llm.common import hash_sample

    df = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("__other", F.lit(1))
    order = [r.doc_id for r in df.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").collect()]
    for n in (1, 7, 200, 900, 5000):
        assert [r.doc_id for r in hash_sample(df, "doc_id", n, 5)] == order[:n]
    assert hash_sample(df.limit(0), "doc_id", 3, 5) == []
    assert hash_sample(df, "doc_id", 7, 5)[0].asDict().keys() == {"doc_id", "__other"}
