"""Merkle audit, sharding, range join, near duplicates and components against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenweft.llm import components, merkle, metric_join, near_dup, two_pass_shuffle

PAGES = "page_id long, url string, html string, digest string, range long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 5) for r in rows], PAGES)


def test_audit_finds_every_fault(spark):
    rows = [(i, f"u{i}", None if i % 7 == 0 else f"h{i}") for i in range(1500)] + [(None, "n", "n"), (4, "u4", "h4")]
    good = pages(spark, rows)
    assert merkle.audit(good, good).count() == 0
    bad = [r for r in rows if r[0] != 700]
    bad[bad.index((3, "u3", "h3"))] = (3, "u3", "h")
    bad[bad.index((7, "u7", None))] = (7, "u7", "")
    bad[bad.index((None, "n", "n"))] = (None, "n", "m")
    bad += [(1600, "x", "x"), (9, "u9", "h9")]
    bad.remove((4, "u4", "h4"))
    found = {r.id: (r.status, r.primary_n, r.replica_n) for r in merkle.audit(good, pages(spark, bad)).collect()}
    assert found == {700: ("missing", 1, 0), 3: ("corrupt", 1, 1), 7: ("corrupt", 1, 1), None: ("corrupt", 1, 1), 1600: ("extra", 0, 1), 9: ("miscounted", 1, 2), 4: ("miscounted", 2, 1)}
    assert merkle.audit(good.limit(0), good.limit(0)).count() == 0
    assert merkle.audit(good, good.limit(0)).where("status <> 'missing'").count() == 0


def test_only_differing_branches_are_opened(spark):
    a = pages(spark, [(i, "u", "h") for i in range(3000)])
    b = pages(spark, [(i, "u", "x" if i == 2050 else "h") for i in range(3000)])
    sides = [merkle.records(x).withColumn("side", F.lit(s)) for s, x in enumerate((a, b))]
    levels = merkle.tree(sides[0].unionByName(sides[1]))
    assert [level.count() for level in levels] == [2 * 47, 2 * 3, 2]
    assert [r.range for r in merkle.differing_ranges(levels).collect()] == [2050 // 64]
    same = merkle.tree(sides[0].unionByName(sides[0].withColumn("side", F.lit(1))))
    assert merkle.differing_ranges(same) is None


@pytest.mark.parametrize("shift", [-700, -(2**63) + 64, 2**62 + 1, 2**63 - 1500])
def test_ids_below_zero_and_beyond_doubles(spark, shift):
    ids = [shift + i for i in range(1400)]
    a = pages(spark, [(i, "u", "h") for i in ids])
    b = pages(spark, [(i, "u", "x" if i in (ids[3], ids[900]) else "h") for i in ids if i != ids[650]])
    found = {r.id: (r.range_begin, r.range_end, r.status) for r in merkle.audit(a, b).collect()}
    assert found == {i: (i // 64 * 64, i // 64 * 64 + 63, s) for i, s in ((ids[3], "corrupt"), (ids[900], "corrupt"), (ids[650], "missing"))}


def test_a_leaf_orders_its_records(spark):
    rows = [(0, 1, 5, "ab"), (1, 1, 6, "ab")]
    levels = merkle.leaves(spark.createDataFrame([(s, r, i, hashlib.sha256(d.encode()).hexdigest()) for s, r, i, d in rows], "side int, range long, id long, digest string"))
    assert len({r.digest for r in levels.collect()}) == 2


def test_shards(spark):
    rows = [(i, "t" * (i % 9), None) for i in range(900)] + [(None, None, "x")] * 3 + [(5, "ttttt", None)] * 400
    table = spark.createDataFrame(rows, "doc_id long, row string, shard string")
    out = two_pass_shuffle.shuffle_into_shards(table, "doc_id", 4, bucket_rows=16).collect()
    assert sorted(((tuple(r["row"])) for r in out), key=repr) == sorted(rows, key=repr)
    for shard in range(4):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    assert all(r.grown_shard in (r.shard, 4) for r in out)
    by_key = {}
    for r in out:
        by_key.setdefault(r["row"]["doc_id"], set()).add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())
    again = two_pass_shuffle.shuffle_into_shards(table.repartition(3), "doc_id", 4, bucket_rows=100000)
    assert again.count() == len(rows)
    one = [(r.shard, r.slot, r["row"]["doc_id"]) for r in two_pass_shuffle.shuffle_into_shards(table.limit(900), "doc_id", 4).collect()]
    two = [(r.shard, r.slot, r["row"]["doc_id"]) for r in two_pass_shuffle.shuffle_into_shards(table.limit(900).repartition(5), "doc_id", 4).collect()]
    assert sorted(one) == sorted(two)
    assert [i for _, _, i in sorted(one)] != sorted(i for _, _, i in one)
    assert two_pass_shuffle.shuffle_into_shards(table.limit(0), "doc_id", 4).count() == 0


def test_shards_hold_whole_rows(spark, monkeypatch):
    written = []
    write = two_pass_shuffle.write_shards
    monkeypatch.setattr(two_pass_shuffle, "write_shards", lambda df, path: (written.append(path), write(df, path)))
    sf = "/root/testdata/sf0.001"
    digests = two_pass_shuffle.query(spark, sf).collect()
    (path,) = written
    shards, docs = spark.read.parquet(path), spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(map(repr, shards.select(*docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert sorted((r.doc_id, r.shard, r.slot) for r in shards.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in digests)
    # a file is one run of slots
    for f in {r[0] for r in shards.select("_metadata.file_path").collect()}:
        slots = [r.slot for r in spark.read.parquet(f).collect()]
        assert slots == list(range(slots[0], slots[0] + len(slots)))


def test_buckets_are_bounded_in_bytes(spark):
    rows = [(i, "t" * (20000 if i % 50 == 0 else i % 9)) for i in range(1000)] + [(3, "u" * 5000)] * 300
    table = spark.createDataFrame(rows, "doc_id long, text string")
    entries, sizes, _ = two_pass_shuffle.scatter(table, "doc_id", 4, seed=17, bucket_rows=256, bucket_bytes=30000)
    at = ["shard", "bucket", "part"]
    found = entries.groupBy(*at).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("bytes")).alias("b")).join(sizes, at).collect()
    assert sum(r["n"] for r in found) == len(rows)
    assert all(r["n"] == r["count"] and r["b"] == r["bytes"] <= 4 * 30000 for r in found)
    out = two_pass_shuffle.shuffle_into_shards(table, "doc_id", 4, bucket_bytes=30000).collect()
    assert sorted(tuple(r["row"]) for r in out) == sorted(rows)
    for shard in range(4):
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))


def test_slots_do_not_depend_on_how_rows_arrive(spark):
    rows = [(i % 3, "t" * (i % 5)) for i in range(700)] + [(1, "same")] * 900 + [(None, None)] * 500 + [(1, None)] * 10
    table = spark.createDataFrame(rows, "doc_id long, text string")
    runs = []
    for some in (table, table.repartition(7), table.orderBy(F.rand(3)), table.coalesce(1)):
        out = two_pass_shuffle.shuffle_into_shards(some, "doc_id", 3, bucket_rows=16)
        runs.append(sorted((r.shard, r.slot, tuple(r["row"]), r.grown_shard) for r in out.collect()))
        assert sorted((tuple(r["row"]) for r in out.collect()), key=repr) == sorted(rows, key=repr)
    assert all(r == runs[0] for r in runs)
    for shard in range(3):
        assert [r[1] for r in runs[0] if r[0] == shard] == list(range(sum(r[0] == shard for r in runs[0])))
    # no part holds more than a bucket's bound, although one row is there 900 times
    entries, sizes, _ = two_pass_shuffle.scatter(table, "doc_id", 3, seed=17, bucket_rows=16, bucket_bytes=1 << 20)
    assert entries.agg(F.max("n")).first()[0] <= 16 and sizes.agg(F.max("count")).first()[0] <= 8 * 16


def test_any_column_rides_along(spark, tmp_path):
    schema = "doc_id long, shard int, Slot string, shard_ string, m map<string,int>, a array<struct<x:int,y:string>>"
    rows = [(i, i % 2, f"s{i}", "z", {"k": i, "l": None}, [(i, None), (None, "y")]) for i in range(300)]
    table = spark.createDataFrame(rows, schema)
    shuffled = two_pass_shuffle.shuffle_into_shards(table, "doc_id", 4, bucket_rows=8)
    path = str(tmp_path / "shards")
    two_pass_shuffle.write_shards(shuffled, path)
    back = spark.read.parquet(path)
    assert sorted(back.columns) == sorted(["doc_id", "shard", "slot", "shard__", "Slot_", "shard_", "m", "a"])
    got = back.select("doc_id", "shard__", "Slot_", "shard_", "m", "a").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r) for r in table.collect())))
    for shard in range(4):
        slots = sorted(r.slot for r in back.where(F.col("shard") == shard).collect())
        assert slots == list(range(len(slots)))


def test_fisher_yates_is_uniform(spark):
    from pyspark.sql import functions as F

    drawn = spark.range(6000).select(two_pass_shuffle.fisher_yates(F.lit(3), F.xxhash64("id")).alias("o")).groupBy("o").count().collect()
    assert len(drawn) == 6 and all(800 < r["count"] < 1200 for r in drawn)


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 440)]
    table = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.components(table).collect()}
    want = brute_components({x for p in links for x in p}, links)
    assert got == {n: c for n, c in want.items() if n in got}
    assert {n for n, c in want.items() if sum(x == c for x in want.values()) > 1} == set(got)
    assert components.components(table.limit(0)).count() == 0


def brute_links(rows, cosine=0.9):
    ok = {}
    for i, (_, v) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0 and rows[i][0] is not None:
            ok[i] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    return [(a, b) for a, b in itertools.combinations(ok, 2) if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine]


@pytest.mark.parametrize("ball", [3, 20, 10**6])
@pytest.mark.parametrize("inside,own", [(True, 400), (True, 300), (False, 250)])
def test_balls_count_what_comparison_counts(monkeypatch, ball, inside, own):
    monkeypatch.setattr(metric_join, "BALL_ROWS", ball)
    rng = np.random.default_rng(own + ball)
    centres = rng.normal(0, 1, (9, 5))
    spread = rng.choice([0.02, 0.12, 0.3], 9)
    kind = rng.integers(0, 9, 400)
    x = centres[kind] + rng.normal(0, 1, (400, 5)) * spread[kind][:, None]
    units = x / np.linalg.norm(x, axis=1)[:, None]
    ids, copies = np.arange(400) * 3, rng.integers(1, 4, 400)
    links, label = metric_join.link_block(ids, copies, units, own, inside, 0.9)
    near = units @ units.T >= 0.9
    i = np.arange(400)
    met = (i[:, None] != i[None, :]) & ((i[:, None] < own) | (i[None, :] < own)) & (inside | ((i[:, None] < own) != (i[None, :] < own)))
    near &= met
    assert (links == near @ copies).all()
    want = brute_components(range(400), [tuple(map(int, p)) for p in zip(*np.nonzero(near))])
    assert label.tolist() == [want[k] for k in range(400)]


@pytest.mark.parametrize("cell_rows,block", [(4096, 16384), (8, 16384), (30, 7)])
def test_range_join(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(metric_join, "OWN_BLOCK", block)
    monkeypatch.setattr(metric_join, "GUEST_BLOCK", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.3, 6)).astype(np.float32).tolist()) for i in range(90)]
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, [0.0] * 6), (93, None), (94, [1.0, None]), (95, [float("nan")] * 6), (96, []), (97, [1.0, 2.0]), (98, [1.0, 2.1]), (None, rows[3][1])]
    links = brute_links(rows)
    table = spark.createDataFrame([(i, v, 1, "u") for i, v in rows], "vec_id long, embedding array<float>, label int, unit string")
    got = {r.vec_id: r for r in metric_join.range_join(table, cell_rows=cell_rows).collect()}
    roots = brute_components(range(len(rows)), links)
    for k, (i, _) in enumerate(rows):
        r = got[i]
        assert r.n_links == sum(k in p for p in links)
        if i is not None:
            assert r.component_id == rows[roots[k]][0] and r.kept == (i == r.component_id)
    assert not got[None].kept and got[None].component_id is None
    assert metric_join.range_join(table.limit(0)).count() == 0


def near_texts(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(rng.choice([6, 40, 200]))] for _ in range(12)]
    texts = []
    for words in base:
        texts.append(words)
        for edits in (0, 1, 2, 8, 30):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    hot = base[2]
    for k in range(60):
        copy = list(hot)
        copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    return [" ".join(t) for t in texts]


def weighted_classes(texts):
    """Classes by exact document frequencies over tuples of words; nothing of the operator is used."""
    import math
    import re
    from collections import Counter

    sets = []
    for text in texts:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        size = min(5, len(words))
        sets.append(Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else Counter())
    df = Counter(s for c in sets for s in c)
    n = sum(map(bool, sets))

    def weight(shingle, tf):
        idf = math.log((n + 1) / (df[shingle] + 1)) / math.log(n + 1)
        return math.exp(round(math.log((1 + math.log(tf)) * (1 + 0.25 * idf)) * 16) / 16)

    weighed = [{s: weight(s, tf) for s, tf in c.items()} for c in sets]
    links = []
    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] is None or texts[b] is None:
            continue
        low = sum(min(w, weighed[b][s]) for s, w in weighed[a].items() if s in weighed[b])
        whole = sum(weighed[a].values()) + sum(weighed[b].values()) - low
        if texts[a] == texts[b] or (whole and low / whole >= 0.8):
            links.append((a, b))
    return brute_components(range(len(texts)), links)


@pytest.mark.parametrize("seed,block,part", [(6, 768, 256), (7, 4, 3), (8, 768, 2)])
def test_classes_against_exact_frequencies(spark, monkeypatch, seed, block, part):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "PART", part)
    texts = ["", "", None, "!!", "one two", "One, two!", *near_texts(seed)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(table).collect()} == weighted_classes(texts)


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    texts = ["", "", None, None, "!!", "!!", "one two", "One, two!", *near_texts()]
    table = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, digest string, id int")
    got = {r.doc_id: r for r in near_dup.near_duplicates(table).collect()}
    counts = np.zeros(near_dup.DF_BUCKETS, np.int64)
    found = [near_dup.shingles(t) for t in texts]
    for f, _ in found:
        counts[np.unique(f >> np.uint64(64 - near_dup.DF_BITS)).astype(int)] += 1
    sampler = near_dup.Sampler(near_dup.df_weights(counts, sum(len(f) > 0 for f, _ in found)))
    weighed = [(f, sampler.levels(f, tf)) for f, tf in found]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] is not None and texts[b] is not None and (texts[a] == texts[b] or near_dup.similarity(weighed[a], weighed[b]) >= 0.8)]
    want = brute_components(range(len(texts)), links)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    kept = near_dup.keep_one(table.unionByName(spark.createDataFrame([(None, "one two", "y", 1), (8, texts[8], "x", 8)], table.schema)))
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, c in want.items() if i == c)
    assert kept.where("doc_id is null").count() == 1
    assert near_dup.near_duplicates(table.limit(0)).count() == 0


@pytest.mark.parametrize("block", [768, 2])
def test_unlike_texts_of_one_doc_id_all_survive(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(120)) for x in "abcd")
    near = lambda t: t.replace("60", "sixty")
    rows = [(7, a), (7, b), (9, a), (3, b), (1, c), (1, d), (1, None), (1, None), (2, near(c)), (4, near(d)), (5, near(a)), (7, a)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dup.near_duplicates(table).collect()}
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (1, False), 5: (3, True), 7: (3, False), 9: (3, False)}
    kept = [tuple(r) for r in near_dup.keep_one(table).collect()]
    assert sorted(kept, key=repr) == sorted([(1, c), (1, d), (1, None), (3, b), (5, near(a))], key=repr)
    first = spark.createDataFrame(rows[:4], "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.keep_one(first).collect()) == sorted([(3, b), (7, a)])
    assert {r.doc_id: (r.class_id, r.kept) for r in near_dup.near_duplicates(first).collect()} == {3: (3, True), 7: (3, True), 9: (3, False)}


def test_a_doc_id_with_two_texts_links_their_classes(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    table = spark.createDataFrame([(1, a), (3, b), (5, a), (5, b), (8, "alone here")], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dup.near_duplicates(table).collect()}
    assert got == {1: (1, True), 3: (1, True), 5: (1, False), 8: (8, True)}


@pytest.mark.parametrize("documents", [200, 10_000, 10_000_000])
def test_weights_follow_exact_document_frequencies(documents):
    """500 shingles a document, each in a bucket with the shingles of others."""
    rng = np.random.default_rng(5)
    others = rng.poisson(500 * documents / near_dup.DF_BUCKETS, near_dup.DF_BUCKETS)
    for df, bound in ((1, 0.05), (documents // 10, 0.01), (documents, 0.01)):
        counts = others.copy()
        counts[:2000] += df
        got = near_dup.df_weights(counts, documents)[:2000].mean()
        exact = 1 + near_dup.DF_SHARE * np.log((documents + 1) / (df + 1)) / np.log(documents + 1)
        assert abs(got - exact) < bound, (df, got, exact)


def test_samples_agree_as_often_as_documents_are_similar():
    rng = np.random.default_rng(2)
    sampler = near_dup.Sampler(near_dup.df_weights(rng.integers(0, 500, near_dup.DF_BUCKETS), 1000))
    errors = []
    for _ in range(40):
        f = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
        sides = []
        for _ in range(2):
            m = rng.random(len(f)) > 0.15
            sides.append((f[m], sampler.levels(f[m], rng.integers(1, 4, m.sum()))))
        agree = (sampler.samples(*sides[0]) == sampler.samples(*sides[1])).mean()
        errors.append(agree - near_dup.similarity(*sides))
    assert abs(np.mean(errors)) < 0.025 and np.std(errors) < 0.09


def test_similarities_of_a_block():
    rng = np.random.default_rng(8)
    f = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2))
    sides = []
    for _ in range(12):
        m = rng.random(len(f)) > 0.3
        sides.append((f[m], rng.integers(0, 30, m.sum())))
    got = near_dup.similarities([near_dup.packed(*s) for s in sides])
    assert np.allclose(got, [[near_dup.similarity(a, b) for b in sides] for a in sides])


def test_samples_do_not_depend_on_order():
    rng = np.random.default_rng(3)
    sampler = near_dup.Sampler(np.ones(near_dup.DF_BUCKETS, np.float32))
    f = rng.integers(0, 1 << 63, 9000, dtype=np.uint64)
    levels = rng.integers(0, 9, 9000)
    turn = rng.permutation(9000)
    assert (sampler.samples(f, levels) == sampler.samples(f[turn], levels[turn])).all()


def test_digest_fields_cannot_be_shifted(spark):
    a = pages(spark, [(1, "ab", "c"), (2, None, ""), (3, "", None)])
    rows = {r.digest for r in merkle.records(a).collect()} | {r.digest for r in merkle.records(pages(spark, [(1, "a", "bc"), (2, "", None)])).collect()}
    assert len(rows) == 5
    assert all(len(d) == len(hashlib.sha256().hexdigest()) for d in rows)
