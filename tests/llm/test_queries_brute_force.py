"""The registered queries on whole small tables against plain Python."""

import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lumenweft.llm import byte_bpe, near_dup, registry, two_pass_shuffle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = db.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_shards(spark, documents):
    rows = registry.queries()["op2_two_pass_shuffle"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        data = (documents[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    by_shard = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(8)}
    assert all(slots == list(range(len(slots))) for slots in by_shard.values())
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(i,) for i in documents], "doc_id long")
    for n, column in ((8, "shard"), (9, "grown_shard")):
        alone = {r.doc_id: r.s for r in ids.select("doc_id", two_pass_shuffle.rendezvous(F.col("doc_id"), n, 17).alias("s")).collect()}
        assert all(alone[r.doc_id] == r[column] for r in rows)


def library():
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens(spark, documents):
    encode = library().encode_ordinary
    rows = registry.queries()["op6_byte_bpe"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = encode(documents[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((documents[r.doc_id] or "").encode()).hexdigest()


def test_packs(spark, documents):
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    pieces = {}
    for i, text in documents.items():
        ids = [*encode(text or ""), 50256]
        pieces |= {(i, p): ids[b : b + 2048] for p, b in enumerate(range(0, len(ids), 2048))}
    rows = registry.queries()["op4_best_fit_packing"](spark, SF).collect()
    assert sorted((d, p) for r in rows for d, p in zip(r.doc_ids, r.pieces)) == sorted(pieces)
    for r in rows:
        ids = list(itertools.chain(*(pieces[d, p] for d, p in zip(r.doc_ids, r.pieces))))
        assert len(ids) == r.n_tokens == r.cu_seqlens[-1] and r.n_segments == len(r.doc_ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids + [50256] * (2048 - len(ids)), "<i4").tobytes()).hexdigest()
        at = [k for b, e in zip(r.cu_seqlens, r.cu_seqlens[1:]) for k in range(e - b)]
        assert r.positions_sha256 == hashlib.sha256(np.array(at + [0] * (2048 - len(at)), "<i4").tobytes()).hexdigest()
    assert len(rows) <= 1.05 * math.ceil(sum(map(len, pieces.values())) / 2048)


def test_classes(spark, documents):
    rows = {r.doc_id: r for r in registry.queries()["op9_weighted_minhash"](spark, SF).collect()}
    assert set(rows) == set(documents)
    found = {i: near_dup.shingles(t) for i, t in documents.items()}
    counts = np.zeros(near_dup.DF_BUCKETS, np.int64)
    for f, _ in found.values():
        counts[np.unique(f >> np.uint64(64 - near_dup.DF_BITS)).astype(int)] += 1
    sampler = near_dup.Sampler(near_dup.df_weights(counts, sum(len(f) > 0 for f, _ in found.values())))
    weighed = {i: (f, sampler.levels(f, tf)) for i, (f, tf) in found.items()}
    root = {i: i for i in documents}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(documents), 2):
        if documents[a] is not None and documents[b] is not None and (documents[a] == documents[b] or near_dup.similarity(weighed[a], weighed[b]) >= 0.8):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert {i: r.class_id for i, r in rows.items()} == {i: find(i) for i in documents}
    assert all(r.kept == (i == r.class_id) for i, r in rows.items())
