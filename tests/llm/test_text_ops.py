"""Byte-level BPE, packing, decontamination and chat formatting against plainer ways."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenweft.llm import byte_bpe, chat, decontaminate, packing

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
BPE = byte_bpe.TreeBpe(byte_bpe.parse_ranks(RANKS), public_tokenizers.PATTERN)
PLAIN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.parse_ranks(RANKS), special_tokens={})
DOCS = "doc_id long, text string, lang string, digest string, score double, spans string, id long"


def docs(spark, *texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "x", 1.0, "s", 7) for i, t in zip(ids, texts, strict=True)], DOCS)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n", max_size=300) | st.text("the in\tg", max_size=200))
def test_tree_bpe_equals_the_library(text):
    assert BPE.encode(text) == PLAIN.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=80), st.integers(0, 80))
def test_joining_two_encodings_is_the_encoding_of_both(data, cut):
    assert BPE.join(BPE.encode_bytes(data[:cut]), BPE.encode_bytes(data[cut:])) == BPE._split(data) if data else True


def test_long_runs():
    for text in ("a" * 20000, "ab" * 9000, "\n" * 5000, "é" * 7000):
        assert BPE.encode(text) == PLAIN.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text("abcd ", max_size=120))
def test_tokens_that_merges_never_make(text):
    """dcba is a token, but its bytes merge otherwise: a whole piece takes it, an inner segment does not."""
    assert ODD.unreachable == {261}
    assert ODD.encode(text) == ODD_PLAIN.encode_ordinary(text)


def test_every_token_of_the_vocabulary_is_reached():
    assert not BPE.unreachable


ODD_RANKS = {bytes([i]): i for i in range(256)} | {b"cd": 256, b"bc": 257, b"ab": 258, b"abcd": 259, b"ba": 260, b"dcba": 261, b"cda": 262}
ODD = byte_bpe.TreeBpe(ODD_RANKS, r"[a-d]+| +")
ODD_PLAIN = tiktoken.Encoding("odd", pat_str=r"[a-d]+| +", mergeable_ranks=ODD_RANKS, special_tokens={})


def test_encode_documents(spark):
    texts = ["", None, "Hello  world\n\n!!", "x" * 50000, "same", "same"]
    rows = byte_bpe.encode_documents(docs(spark, *texts, ids=[0, 1, 2, 3, 4, None]), RANKS, public_tokenizers.PATTERN).collect()
    for row, text in zip(rows, texts, strict=True):
        ids = PLAIN.encode_ordinary(text or "")
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    again = byte_bpe.decode_ids(byte_bpe.encode_documents(docs(spark, *texts), RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert [r.text for r in again] == [t or "" for t in texts]


def brute_best_fit(lengths, most):
    packs = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [p for p in packs if sum(lengths[j] for j in p) + lengths[i] <= most]
        if fits:
            max(fits, key=lambda p: sum(lengths[j] for j in p)).append(i)
        else:
            packs.append([i])
    return packs


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_segment_tree_packs_as_well_as_a_search(lengths):
    packs = packing.best_fit_decreasing(lengths, 40)
    assert sorted(i for p in packs for i in p) == list(range(len(lengths)))
    room = lambda ps: sorted(sum(lengths[i] for i in p) for p in ps)
    assert room(packs) == room(brute_best_fit(lengths, 40))


def test_packs_hold_every_document(spark):
    rng = random.Random(3)
    texts = [None, "", *("w " * rng.randint(0, 400) for _ in range(40)), "long " * 3000]
    table = docs(spark, *texts)
    packs = packing.pack_documents(table, RANKS, public_tokenizers.PATTERN, 50256, length=256, chunk_tokens=2000)
    rows = packs.collect()
    assert len({r.pack_id for r in rows}) == len(rows)
    for r in rows:
        ids, positions = np.frombuffer(r.ids, "<i4"), np.frombuffer(r.positions, "<i4")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_tokens <= 256
        assert (ids[r.n_tokens :] == 50256).all()
        for b, e in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[b:e].tolist() == list(range(e - b))
    whole = {}
    for r in sorted(packing.unpack(packs).collect(), key=lambda r: (r.doc_id, r.piece)):
        whole.setdefault(r.doc_id, []).extend(r.ids)
    assert whole == {i: [*PLAIN.encode_ordinary(t or ""), 50256] for i, t in enumerate(texts)}
    assert packing.pack_documents(table.limit(0), RANKS, public_tokenizers.PATTERN, 50256).count() == 0


def brute_contamination(text, items):
    words = decontaminate.words_of(text)
    hit, owners = set(), set()
    for item, body in items:
        for w in decontaminate.windows_of(decontaminate.words_of(body)):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    owners |= {item} if item is not None else set()
    return len(words), len(hit), len(owners), sorted(owners), bool(hit) and 20 * len(hit) >= len(words)


def test_contamination(spark):
    rng = random.Random(5)
    w = lambda n: " ".join(rng.choice("the of and a b c d Zoé ß 12".split()) for _ in range(n))
    items = [(i, w(rng.choice([3, 12, 13, 14, 30]))) for i in range(12)] + [(90, ""), (91, "!!"), (3, "the of"), (92, None), (None, "zoé ß 12 zoé")]
    bench = spark.createDataFrame([(*i, "q") for i in items], "item_id long, text string, words string")
    texts = [None, "", "...", *(w(rng.choice([1, 30, 300])) for _ in range(30)), w(20) + " " + items[4][1].upper() + ", " + w(50), "the, OF!"]
    table = docs(spark, *texts)
    for block in (1 << 20, 100):
        got = {r.doc_id: r for r in decontaminate.contamination(table, bench, block_bytes=block).collect()}
        for i, text in enumerate(texts):
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) == brute_contamination(text, items)
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest()
        kept = decontaminate.clean(table, bench, block_bytes=block)
        assert kept.columns == table.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.contamination(table, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.contamination(table.limit(0), bench).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "\\n", "<|im_end|>"]), st.text("<\\|im_endstar>\n ", max_size=30)), max_size=5))
def test_template_reads_back(messages):
    text, spans = chat.render(messages)
    assert chat.parse(text) == messages
    assert [chat.unescape(text[s["begin"] : s["end"]]) for s in spans] == [t for r, t in messages if r == "assistant"]


def test_fold_of_a_log(spark):
    log = [
        (1, 0, 1, "open", "user", "hi"), (1, 1, 2, "open", "assistant", ""), (1, 2, 2, "delta", None, "wro"), (1, 3, 2, "delta", None, "ng"),
        (1, 4, 3, "open", "user", "why"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "right"), (1, 7, 1, "edit", None, "hi!"),
        (1, 8, 9, "delta", "tool", "x"), (1, 9, 9, "delete", None, None), (1, 10, 8, "delete", None, None), (1, 11, 1, "unknown", None, None),
        (2, 0, 1, "open", None, None), (None, 5, 1, "open", "user", "n"), (None, 4, 2, "open", "user", "m"),
    ]
    random.Random(1).shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, msg long, event string, role string, text string")
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_log(events).collect()}
    assert got == {1: [("user", "hi!"), ("assistant", "right")], 2: [("", "")], None: [("user", "m"), ("user", "n")]}
    assert chat.format_log(events.limit(0)).count() == 0


def test_conversations_survive_the_log(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "é<|im_end|>"), (2, 0, "assistant", "y" * 20000), (3, 0, "assistant", "")]
    table = spark.createDataFrame([(*r, "e", 1) for r in rows], "conv_id long, turn long, role string, text string, event string, msg int")
    out = {r.conv_id: chat.parse(r.formatted) for r in chat.format_log(chat.events_of(table)).collect()}
    assert out == {1: [("user", ""), ("assistant", "b"), ("assistant", "b")], 2: [("", "é<|im_end|>"), ("assistant", "y" * 20000)], 3: [("assistant", "")]}
    again = {r.conv_id: r for r in chat.digests(chat.format_log(chat.events_of(table))).collect()}
    assert again[1].n_turns == 3 and again[1].loss_chars == 2 and again[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()


@pytest.mark.parametrize("text", ["", "<", "<|", "<\\|", "<\\\\|x<|", "\\"])
def test_escape_is_undone(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
