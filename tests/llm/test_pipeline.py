"""The pipeline against its stages taken alone and against brute force."""

import hashlib
import itertools

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from lumenweft.llm import byte_bpe, decontaminate, near_dup, quality_pu, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= before
        labels = spark.read.parquet(f"{SF}/labels.parquet")
        if stage is corpus_pipeline.quality:
            own = quality_pu.score_documents(docs, quality_pu.fit(docs, labels)).where("predicted = 1")
        elif stage is corpus_pipeline.toxic:
            own = toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("predicted = 0")
        elif stage is corpus_pipeline.near_duplicates:
            own = near_dup.near_duplicates(docs).where("kept")
        else:
            own = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated")
        assert kept == {r.doc_id for r in own.collect()}, name
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.encoded(spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == kept


def first_of_groups(texts):
    """The least id of each group of near duplicates, all pairs compared."""
    found = {i: near_dup.shingles(t) for i, t in texts.items()}
    counts = np.zeros(near_dup.DF_BUCKETS, np.int64)
    for f, _ in found.values():
        counts[np.unique(f >> np.uint64(64 - near_dup.DF_BITS)).astype(int)] += 1
    sampler = near_dup.Sampler(near_dup.df_weights(counts, sum(len(f) > 0 for f, _ in found.values())))
    weighed = {i: (f, sampler.levels(f, tf)) for i, (f, tf) in found.items()}
    label = {i: i for i in texts}
    for a, b in itertools.combinations(sorted(texts), 2):
        if texts[a] == texts[b] or near_dup.similarity(weighed[a], weighed[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    return {i for i, c in label.items() if i == c}


def test_run_equals_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = {r.doc_id: r.text for r in docs.collect()}

    def frame():
        return spark.createDataFrame(sorted(left.items()), "doc_id long, text string")

    model = quality_pu.fit(frame(), labels)
    left = {i: t for i, t in left.items() if quality_pu.score(model, quality_pu.features(t)[None])[0] >= 0.7}
    scorer = toxicity.Scorer(toxicity.fit(frame(), labels))
    left = {i: t for i, t in left.items() if scorer([t])[0] < 0.7}
    first = first_of_groups(left)
    left = {i: t for i, t in left.items() if i in first}
    windows = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decontaminate.windows_of(decontaminate.words_of(r.text))}
    sizes = {len(w) for w in windows}

    def contaminated(text):
        words = decontaminate.words_of(text)
        hit = {p for n in sizes for i in range(len(words) - n + 1) if tuple(words[i : i + n]) in windows for p in range(i, i + n)}
        return bool(hit) and 20 * len(hit) >= len(words)

    left = {i: t for i, t in left.items() if not contaminated(t)}
    ranks = byte_bpe.parse_ranks(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    want = {}
    for i, t in left.items():
        ids = encode(t or "")
        want[i] = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
    assert 0 < len(rows) < docs.count()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want and len(rows) == len(want)
