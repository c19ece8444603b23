"""MinHash near-duplicates by improved consistent weighted sampling.

A document is a weighted set of shingles of ``SHINGLE`` words (a text of fewer
words, but not none, is one shingle).  A shingle's weight is its term weight
1 + ln(tf) times a document-frequency weight

    1 + DF_SHARE * idf / idf_max,   idf = ln((N + 1) / (df + 1)),  idf_max = ln(N + 1)

with df counted over all documents in ``DF_BUCKETS`` hashed buckets, less the
count that a bucket has of other shingles: the median over the buckets, so that
a shingle of one document weighs about the same at any N.  What is left is the
spread of the buckets about their median; counts are exact only while the
shingles are few against the buckets.  Shared passages weigh less than a document's own words, yet copies of one
document in a large group stay similar.  Weights are rounded to a geometric
grid, in the sampling as in the verification.

Sampling is Ioffe's: for each of BANDS * ROWS hash functions a shingle draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) the sample is
the (shingle, t) of least c / (w-grid point * e^r).  Draws come from a table of
2^16 triples that the shingle's hash picks, so a sample costs one look-up.  Two
documents agree in a sample with the probability of their weighted Jaccard
similarity; at 0.8 they share a band with probability 1 - 3e-5.

Verification is exact.  Equal texts collapse first.  Within a band's bucket
every member is compared with the bucket's least document by weighted Jaccard
on the texts; the members are dealt in salted parts of about ``PART`` to copies of
that document, so that a document with very many members is no hot key.  Buckets that these links leave in several components are opened
again, one of each set of members: in blocks of bounded size, the similarity of
members of unlike components is a product of their sparse shingle matrices, and
a spanning forest of the links leaves the kernel.  So no group is expanded into
its pairs, no bucket is capped and no link between components is lost.

Defined cases: equal texts are duplicates, also empty ones and those without
words; a null text or a null doc_id has no duplicates; rows with the same doc_id
and the same text count as one; ties go to the least doc_id, then the least
digest of the text, which stays.  A doc_id with unlike texts links the classes
of all of them, so that no link is lost: its documents share one class_id.  What
stays is judged by text, so that no text is lost either: :func:`keep_one` keeps
rows by doc_id and text, and :func:`near_duplicates` calls a doc_id kept if any
of its texts is the first of its group (a class united by a doc_id alone thus
keeps a document for each group of like texts).  Further columns are ignored by
:func:`near_duplicates` and kept by :func:`keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored, table
from .components import components
from .decontaminate import words_of
from .metric_join import _forest

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
SAMPLES = BANDS * ROWS
DF_BITS = 18
DF_BUCKETS = 1 << DF_BITS
#: Counts of one row of the table on its way.
SLICE = 8192
#: How much more a shingle that no other document has can weigh than one that all have.
DF_SHARE = 0.25
#: The most members of a bucket that one comparison holds, on either side.
BLOCK = 768
#: Members compared with one copy of a bucket's least document.
PART = 256
#: Columns of the shingle matrix multiplied at a time.
COLUMNS = 1024
_GRID = 1 / 16  # of ln w
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POSITION = _mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _MULTIPLY) | np.uint64(1)


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes, sorted, and how often each occurs."""
    from xxhash import xxh3_64_intdigest

    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = h[:n] * _POSITION[0]
    for k in range(1, size):
        total = total + h[k : k + n] * _POSITION[k]
    return np.unique(_mix(total), return_counts=True)


def df_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per hashed bucket of shingles, and the number of documents with any; a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(DF_BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py())[0]
                if len(found):
                    seen += 1
                    total[np.unique(found >> np.uint64(64 - DF_BITS)).astype(np.int64)] += 1
        parts = [total[at : at + SLICE].tobytes() for at in range(0, DF_BUCKETS, SLICE)] if seen else []
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([seen] * k, pa.int64()), pa.array(parts, pa.binary())], ["slice", "seen", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in t["counts"]:
            total += np.frombuffer(x.as_buffer(), np.int64)
        return pa.table({"slice": pa.array([t["slice"][0].as_py()], pa.int32()), "seen": pa.array([sum(t["seen"].to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    ddl = "slice int, seen long, counts binary"
    sums = docs.select("text").mapInArrow(count, ddl).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    sums = sums.groupBy("slice", "salt").applyInArrow(lambda t: add(t.select(["slice", "seen", "counts"])), ddl)
    out, seen = np.zeros(DF_BUCKETS, np.int64), 0
    for r in sums.groupBy("slice").applyInArrow(add, ddl).toLocalIterator():
        out[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, np.int64)
        seen = r.seen
    return out, seen


def df_weights(counts: np.ndarray, documents: int) -> np.ndarray:
    """1 + DF_SHARE * idf / idf_max for each bucket, its count less the median bucket's."""
    top = np.log(max(2.0, documents + 1.0))
    own = np.maximum(counts - np.floor(np.median(counts)), np.minimum(counts, 1))
    idf = np.log((documents + 1.0) / (own + 1.0))
    return (1 + DF_SHARE * np.maximum(0, idf) / top).astype(np.float32)


class Sampler:
    """Weights and samples of documents under one table of document frequencies."""

    def __init__(self, weights: np.ndarray, seed: int = 41):
        rng = np.random.default_rng(seed)
        self.weights = weights
        self.r = rng.gamma(2, 1, 1 << 16)
        self.log_c = np.log(rng.gamma(2, 1, 1 << 16))
        self.b = rng.random(1 << 16)
        self.odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.log_a: list[np.ndarray] = []
        self.t: list[np.ndarray] = []

    def levels(self, found: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Grid points of ln w."""
        w = self.weights[(found >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        return np.rint(np.log((1 + np.log(tf)) * w) / _GRID).astype(np.int64)

    def _grow(self, level: int) -> None:
        while len(self.t) <= level:
            log_w = len(self.t) * _GRID
            t = np.floor(log_w / self.r + self.b)
            self.t.append(t.astype(np.int16))
            self.log_a.append((self.log_c - self.r * (t - self.b) - self.r).astype(np.float32))

    def samples(self, found: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """A 64-bit value for each hash function."""
        self._grow(int(levels.max()))
        best = np.full(SAMPLES, np.inf, np.float32)
        value = np.zeros(SAMPLES, np.uint64)
        column = np.arange(SAMPLES)
        for level in np.unique(levels):
            own = found[levels == level]
            log_a, t = self.log_a[level], self.t[level]
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                draw = (part[:, None] * self.odd[None, :]) >> np.uint64(48)
                a = log_a[draw]
                least = a.argmin(0)
                low = a[least, column]
                better = low < best
                # equal draws: the lesser value, so that the order of shingles does not matter
                made = _mix(part[least] + t[draw[least, column]].astype(np.uint64) * _MULTIPLY)
                same = (low == best) & (made < value)
                best = np.where(better, low, best)
                value = np.where(better | same, made, value)
        return value


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, levels)."""
    wa, wb = np.exp(a[1] * _GRID), np.exp(b[1] * _GRID)
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(wa[i], wb[j]).sum()
    return float(low / (wa.sum() + wb.sum() - low)) if len(a[0]) or len(b[0]) else 0.0


def band_keys(values: np.ndarray) -> np.ndarray:
    by_band = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _MULTIPLY
    for k in range(ROWS):
        key = _mix(key + by_band[:, k] * _POSITION[k])
    return key.astype(np.int64)


def _sketches(docs: DataFrame, weights) -> DataFrame:
    """id, digest of the text and keys of its bands; no keys without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(weights.value)
        for batch in batches:
            keys = []
            for text in batch.column(2):
                found, tf = shingles(text.as_py())
                keys.append(band_keys(sampler.samples(found, sampler.levels(found, tf))) if len(found) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "keys"])

    named = docs.select(F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    return named.where("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "id long, digest string, keys array<long>")


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and text of the wanted nodes."""
    named = classes.select("node", F.col("id").alias("doc_id"), "digest").join(wanted, "node", "left_semi")
    texts = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    return texts.join(named, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("node", "text")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, weights, threshold: float) -> DataFrame:
    """Of the pairs (a, b: nodes) those whose texts are similar enough; a stored table."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = stored(_texts(docs, classes, wanted))
    left, right = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab")
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("long").alias("parts"))
    salted = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    copied = left.join(parts, "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = salted.join(right, "b").join(copied, ["a", "part"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(weights.value)

        def known(text: str) -> tuple[np.ndarray, np.ndarray]:
            found, tf = shingles(text)
            return found, sampler.levels(found, tf)

        last, weighed = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
                text = ta.as_py()
                if weighed is None or text != last:
                    last, weighed = text, known(text)
                keep.append(similarity(weighed, known(tb.as_py())) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    edges = stored(both.mapInArrow(run, "a long, b long"))
    dropped(texts)
    return edges


def packed(found: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Hash (58 bits) and level (6 bits) of each shingle, sorted."""
    return np.sort((found >> np.uint64(6)) << np.uint64(6) | np.minimum(levels, 63).astype(np.uint64))


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard of all packed sets with each other.

    A weight is a stack of layers, one for each level that its shingle has in
    any set, so that the sum of lesser weights is a product of 0/1 matrices.
    """
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    columns, place = np.unique(flat, return_inverse=True)
    shingle = columns >> np.uint64(6)
    weight = np.exp((columns & np.uint64(63)).astype(np.float64) * _GRID)
    total = np.bincount(row, weight[place], n)
    fresh = np.r_[True, shingle[1:] != shingle[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(columns)), 0))
    layer = weight - np.where(fresh, 0, np.r_[0, weight[:-1]])
    # a set has the layers of its shingle up to its own level
    depth = place - first[place] + 1
    row, column = np.repeat(row, depth), np.repeat(place, depth) - (np.arange(depth.sum()) - np.repeat(np.cumsum(depth) - depth, depth))
    shared = np.bincount(column, minlength=len(columns)) > 1
    number = np.cumsum(shared) - 1
    on = shared[column]
    row, column, layer = row[on], number[column[on]], layer[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    low = np.zeros((n, n))
    for at in range(0, len(layer), COLUMNS):
        b, e = np.searchsorted(column, (at, at + COLUMNS))
        width = min(COLUMNS, len(layer) - at)
        x = np.zeros((n, width))
        x[row[b:e], column[b:e] - at] = 1
        low += (x * layer[at : at + width]) @ x.T
    np.fill_diagonal(low, total)
    return low / (total[:, None] + total[None, :] - low)


def _open_again(banded: DataFrame, linked: DataFrame, docs: DataFrame, classes: DataFrame, weights, threshold: float) -> DataFrame:
    """Edges (a, b), a spanning forest in each block, between members of unlike components of one bucket; a stored table."""
    labelled = banded.join(linked, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    # two members were compared already; of buckets with the same members one is enough
    buckets = labelled.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("first"))
    mixed = buckets.where("m > 2 AND lo < hi").groupBy("m", "x", "first").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).alias("blocks"))
    rest = stored(labelled.join(mixed, "key"))
    texts = _texts(docs, classes, rest.select("node").distinct())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(weights.value)
        for batch in batches:
            sets = []
            for text in batch.column(1):
                found, tf = shingles(text.as_py())
                sets.append(packed(found, sampler.levels(found, tf)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    sets = texts.mapInArrow(pack, "node long, set binary")
    spread = rest.withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("key", F.least("k", "j").alias("i"), F.greatest("k", "j").alias("j"), "k", "node", "c").join(sets, "node")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("node").combine_chunks()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        nodes, c, k = t["node"].to_numpy(), t["c"].to_numpy(), t["k"].to_numpy()
        near = similarities([np.frombuffer(x.as_buffer(), np.uint64) for x in t["set"]]) >= threshold
        near &= (c[:, None] != c[None, :]) & (k == i)[:, None] & (k == j)[None, :]
        a, b = np.nonzero(near)
        label = _forest(np.arange(len(nodes)), a, b)
        on = label != np.arange(len(nodes))
        return pa.table({"a": nodes[label[on]], "b": nodes[on]})

    compared = spread.select("key", "i", "j", "k", "node", "c", "set")
    edges = stored(compared.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct())
    dropped(rest)
    return edges


def _texts_judged(docs: DataFrame, threshold: float) -> DataFrame:
    """doc_id and digest of each text of a doc_id, class_id (least doc_id of the texts near it) and whether the row stays; a stored table."""
    counts, documents = df_counts(docs)
    weights = docs.sparkSession.sparkContext.broadcast(df_weights(counts, documents))
    sketches = stored(_sketches(docs, weights))
    # a text is a node, numbered in the order of its least doc_id and its digest
    numbered = sketches.groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys"))
    classes = stored(numbered.repartitionByRange("id", "digest").sortWithinPartitions("id", "digest").withColumn("node", F.monotonically_increasing_id()))
    banded = classes.select("node", F.explode("keys").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1").select("key", "hub")
    banded = stored(banded.join(hubs, "key"))
    stars = banded.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    edges = _verified(stars, docs, classes, weights, threshold)
    linked = stored(components(edges))
    more = _open_again(banded.select("key", "node"), linked, docs, classes, weights, threshold)
    if not more.isEmpty():
        first, linked = linked, stored(components(edges.unionByName(more)))
        dropped(first)
    firsts = classes.select(F.col("node").alias("component"), F.col("id").alias("class_id"))
    moved = linked.where("node <> component").join(firsts, "component").select("node", "class_id")
    rooted = classes.select("node", "digest", "id").join(moved, "node", "left").select("digest", "id", "class_id")
    copies = sketches.select(F.col("id").alias("doc_id"), "digest").distinct().join(rooted, "digest")
    first = F.col("class_id").isNull() & (F.col("doc_id") == F.col("id"))
    judged = stored(copies.select("doc_id", "digest", F.coalesce("class_id", "id").alias("class_id"), first.alias("stays")))
    dropped(sketches, classes, banded, edges, linked, more)
    return judged


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of the group) and kept, one row per doc_id of the input."""
    judged = _texts_judged(docs, threshold)
    by_doc = judged.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("class_id").alias("most"), F.max("stays").alias("stays"))
    # a doc_id whose texts are of unlike classes links them
    several = by_doc.where("class_id < most").select("doc_id")
    named = judged.join(several, "doc_id")
    united = components(named.select(F.col("class_id").alias("a"), F.col("doc_id").alias("b")))
    by_doc = by_doc.join(united.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    found = by_doc.select("doc_id", F.coalesce("component", "class_id").alias("class_id"), "stays")
    everyone = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("text").isNull()).alias("bare")).join(found, "doc_id", "left")
    kept = F.coalesce(F.col("bare") | F.col("stays"), F.lit(True))
    return everyone.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, all their columns, whose text is the first of its group; rows without doc_id all stay."""
    gone = _texts_judged(docs, threshold).where("NOT stays").select("doc_id", F.col("digest").alias("__digest"))
    named = docs.where("doc_id IS NOT NULL").withColumn("__digest", F.md5(F.col("text").cast("binary")))
    named = named.join(gone, ["doc_id", "__digest"], "left_anti").dropDuplicates(["doc_id", "__digest"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
