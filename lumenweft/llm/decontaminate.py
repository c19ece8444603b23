"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one
window).  A document must hold the whole window, so the necessary prefix under
a containment of 1 is a single word: the window's rarest, by its count over all
documents.  Each occurrence of such a word proposes the windows that have it,
each at one offset; the length and positional bounds (the window must begin at
or after the document's first word and end by its last) discard some, and the
rest are verified word for word over a slice as long as the window.

The documents are read twice, without a shuffle: once to count the words that
the items use, once to match.  The items' index is broadcast where one block of
bounded size holds it.  A larger benchmark is worked off block by block: the
documents are written once with a number for each row, every block's hits are
found in a pass of their own, written, and its broadcast given back before the
next one is built, so that no process ever holds two; the blocks' hits are then
united by row number.

Defined cases: a null or empty text has no words, is never hit and not
contaminated; an item without words has no window; repeated item ids count
once; ties in rarity go to the word's bytes; a null item id never counts as an
item, though its words hit.  Further columns are ignored by :func:`contamination`
and kept by :func:`clean`.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_bound, checkpointed, table

WINDOW = 13
#: Item text in one broadcast block (its index takes about 60 times that); more items make more blocks.
BLOCK_BYTES = 4 << 20
#: A-Z lower-cased; every ASCII byte that the word pattern leaves out is a space.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return text.encode().translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


def build_index(items: list[tuple[int | None, str | None]], counts: dict[bytes, int], size: int = WINDOW) -> dict:
    """rarest word -> [(offset, length, {window: item ids})]."""
    index: dict[bytes, dict[tuple[int, int], dict]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
    for item, text in items:
        for window in windows_of(words_of(text), size):
            offset = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
            owners = index[window[offset]][offset, len(window)][window]
            if item is not None:
                owners.add(item)
    return {word: [(o, n, {w: frozenset(s) for w, s in d.items()}) for (o, n), d in by.items()] for word, by in index.items()}


def match(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged [begin, end) spans of hit words, and the items with an occurring window."""
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    total = len(words)
    found = index.keys() & set(words)
    if not found:
        return spans, items
    for at, word in enumerate(words):
        if word in found:
            for offset, length, windows in index[word]:
                begin = at - offset
                if begin < 0 or begin + length > total:
                    continue
                owners = windows.get(tuple(words[begin : begin + length]))
                if owners is not None:
                    spans.append((begin, begin + length))
                    items |= owners
    return merge(spans), items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((begin, end))
    return out


def _verdict(n_words: int, spans: list[tuple[int, int]], items: set[int]) -> tuple:
    hit = sum(e - b for b, e in spans)
    names = ",".join(sorted(map(str, items)))
    return n_words, hit, len(items), hashlib.sha256(names.encode()).hexdigest(), hit > 0 and 20 * hit >= n_words


def _count_words(docs: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """How often the wanted words occur in all documents; one row per task and word comes back summed."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        keep = shared.value
        for batch in batches:
            for text in batch.column(0):
                counts.update(filter(keep.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.toLocalIterator()}  # at most the block's own words


def _blocks(docs: DataFrame, benchmark: DataFrame, size: int, block_bytes: int) -> Iterator:
    """Broadcast indexes over all items, one at a time, each built from about ``block_bytes`` of item text or one longer item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).distinct()
    n = max(1, -(-byte_bound(items, "text") // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r.item_id, r.text) for r in part.toLocalIterator()]
        wanted = {w for _, t in rows for w in words_of(t)}
        index = build_index(rows, _count_words(docs, wanted), size)
        yield n, spark.sparkContext.broadcast(index)


def _hits(numbered: DataFrame, index) -> DataFrame:
    """Of one block: row, spans and items of the documents in which some window occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, items = [], [], []
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                s, i = match(words_of(text.as_py()), index.value)
                if s:
                    rows.append(row.as_py())
                    spans.append([{"begin": b, "end": e} for b, e in s])
                    items.append(sorted(i))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.int64()))], ["__row", "spans", "items"])

    return numbered.select("__row", "text").mapInArrow(run, "__row long, spans array<struct<begin: long, end: long>>, items array<long>")


_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _judged(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, verdict: Callable[[pa.RecordBatch, list[tuple]], pa.RecordBatch], schema) -> DataFrame:
    """Apply ``verdict`` (a batch; number of words, spans and items of each of its documents) to all documents."""
    names = docs.columns
    at = names.index("text")
    blocks = _blocks(docs, benchmark, window, block_bytes)
    n, index = next(blocks)
    if n == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for text in batch.column(at):  # one document's words at a time
                    words = words_of(text.as_py())
                    found.append((len(words), *match(words, index.value)))
                yield verdict(batch, found)

        return docs.mapInArrow(run, schema)
    numbered = checkpointed(docs.withColumn("__row", F.monotonically_increasing_id()))
    hits = None
    while index is not None:
        some = checkpointed(_hits(numbered, index))
        index.destroy()
        hits = some if hits is None else hits.unionByName(some)
        _, index = next(blocks, (n, None))
    hits = hits.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.flatten(F.collect_list("items")).alias("__items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(words_of(t.as_py())) for t in batch.column(at)]
            spans = [merge([(x["begin"], x["end"]) for x in s or ()]) for s in batch.column(len(names)).to_pylist()]
            items = [set(i or ()) for i in batch.column(len(names) + 1).to_pylist()]
            yield verdict(pa.RecordBatch.from_arrays(batch.columns[: len(names)], names), list(zip(sizes, spans, items, strict=True)))

    return numbered.join(hits, "__row", "left").select(*[F.col(f"`{c}`") for c in names], "__spans", "__items").mapInArrow(unite, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""

    def verdict(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        n, hit, k, sha, bad = zip(*[_verdict(*f) for f in found], strict=True) if found else ((),) * 5
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_()),
                pa.array([[{"begin": b, "end": e} for b, e in s] for _, s, _ in found], _SPANS), pa.array([sorted(i) for *_, i in found], pa.list_(pa.int64())),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
        )

    return _judged(docs.select("doc_id", "text"), benchmark, window, block_bytes, verdict, f"doc_id long, {_RESULT}, spans array<struct<begin: long, end: long>>, items array<long>")


def clean(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all their columns, that are not contaminated."""

    def verdict(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        keep = [not _verdict(n, s, set())[4] for n, s, _ in found]
        return batch.filter(pa.array(keep, pa.bool_()))

    return _judged(docs, benchmark, window, block_bytes, verdict, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), grams AS (
  SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM doc_words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (
  SELECT g.doc_id, g.i, g.size, v.item_id FROM grams g JOIN windows v ON g.size = v.size AND g.win = v.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id
), owners AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(o.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(o.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hits h USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""
