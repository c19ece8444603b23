"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns in every stage and query."""

import json

import pytest

import corpus_pipeline
from lumenweft.llm import chat, packing, registry

SF = "/root/testdata/sf0.001"
CLASHES = "score double, predicted int, held_out boolean, digest string, keys array<long>, key long, ids string, spans string, items string, __text string, component long, node long, class_id long, kept string, u long, v long"
LONG = "mot " * 60000


@pytest.fixture(scope="module")
def odd_docs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) + (None,) * 16 for r in docs.limit(60).collect()]
    doc_id, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def row(i, t):
        out = [None] * len(docs.columns)
        out[doc_id], out[text] = i, t
        return tuple(out) + (None,) * 16

    rows += [row(9001, None), row(9002, ""), row(9003, ""), row(9004, LONG), row(9005, "x" * 200000), row(9006, "?!"), row(None, "no id"), row(None, None), rows[0], rows[0]]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", " + CLASHES
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stage_takes_odd_rows(spark, odd_docs, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd_docs, SF)
    rows = out.collect()
    last = k == len(corpus_pipeline.STAGES) - 1
    assert last or out.columns == odd_docs.columns
    assert len(rows) <= odd_docs.count() and rows
    if last or name == "benchmark decontamination":
        assert {9001, 9002, 9003, 9004, 9005, 9006, None} <= {r.doc_id for r in rows}
    if name == "minhash near-dedup":
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and 9002 in ids and 9003 not in ids and {9001, 9004, 9005, 9006} <= set(ids)
        assert sum(r.doc_id is None for r in rows) == 2
    empty = stage(spark, odd_docs.limit(0), SF)
    assert empty.count() == 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_queries_on_tables_of_odd_rows(spark, tmp_path, name):
    """Every query with empty tables, and with tables that hold a few odd rows and further columns."""
    tables = {
        "documents": ("doc_id long, text string, lang string, source string, n_chars long, score double, digest string, id long", [(1, "a b c", None, None, None, 1.0, "d", 1), (2, None, "en", "s", 0, None, None, None), (None, "", None, None, None, None, None, None), (1, "a b c", None, None, None, 1.0, "d", 1), (3, LONG, "en", "s", 1, 0.0, "", 2)]),
        "labels": ("doc_id long, quality int, toxic int, text string", [(1, 1, 0, "t"), (2, 0, 1, None), (None, None, None, None), (3, None, 1, "")]),
        "benchmark": ("item_id long, text string, doc_id long", [(1, "a b c", 1), (None, "q", None), (2, None, 2), (1, "a b c", 1)]),
        "embeddings": ("vec_id long, embedding array<float>, label int, id long", [(1, [1.0, 0.0], 0, 1), (2, [1.0, 0.01], 0, 1), (3, None, 0, None), (None, [1.0, 0.0], 1, 2), (1, [1.0, 0.0], 0, 1)]),
        "pages": ("page_id long, url string, html string, digest string", [(1, "u", None, "d"), (7, None, "h", "d"), (None, "u", "h", None), (7, None, "h", "d")]),
        "conversations": ("conv_id long, turn long, role string, text string, event string", [(1, 0, "user", None, "e"), (1, 0, "user", None, "e"), (1, 1, None, "<|im_end|>", None), (None, None, "assistant", "x", "e")]),
    }
    for kind in ("empty", "odd"):
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows if kind == "odd" else [], schema).coalesce(1).write.parquet(f"{tmp_path}/{kind}/{t}.parquet")
        rows = registry.queries()[name](spark, f"{tmp_path}/{kind}").collect()
        if kind == "empty":
            assert len(rows) == (1 if name.startswith("op10_") else 0)
        elif name.startswith(("op2_", "op3_", "op5_", "op6_", "op7_", "op8_")):
            assert len(rows) == 5
        elif name.startswith("op9_"):
            assert sorted(r.doc_id for r in rows) == [1, 2, 3]
        elif name.startswith("op10_"):
            assert sorted((r.conv_id is not None, r.conv_id or 0, r.n_turns) for r in rows) == [(False, 0, 1), (True, -1, 2), (True, 1, 3)]


def test_ids_of_packs_are_unique_over_many_partitions(spark):
    import public_tokenizers

    from lumenweft.llm.byte_bpe import read_ranks

    docs = spark.range(300).selectExpr("id as doc_id", "repeat('w ', int(id % 40)) as text").repartition(7)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = packing.pack_documents(docs, ranks, public_tokenizers.PATTERN, 50256, length=32, chunk_tokens=100).collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    assert sorted({i for r in rows for i in r.doc_ids}) == list(range(300))


def test_formatted_text_survives_json(spark):
    text, spans = chat.render([("user", 'a"\n<|im_start|>'), ("assistant", "b <|im_end|>")])
    assert chat.parse(json.loads(json.dumps(text))) == [("user", 'a"\n<|im_start|>'), ("assistant", "b <|im_end|>")]
    assert len(spans) == 1
