"""Token packing: best-fit decreasing with a segment tree over capacities.

Documents become token ids plus an end-of-text id.  One longer than a pack is
split, without loss, into full pieces and a rest.  Pieces are taken by
decreasing length; each goes into the open pack with the least room that still
holds it.  A segment tree over the room left (0..L) finds that pack in log L
steps.  Packs are rows of an id matrix with cumulative segment lengths and
positions that start at 0 in every segment.

Packing runs where the documents are read, over consecutive documents of about
``CHUNK_TOKENS`` tokens, so no row moves and no key can crowd a task; only the
last packs of a chunk are less than full.  ``pack_id`` numbers partition, chunk
and pack.  A lost task reads the same rows again and gives the same packs.

Defined cases: a null or empty text is its end-of-text id alone; pieces of the
same length keep the order of reading; repeated rows are packed each; a null
doc_id stays null; an empty table gives no packs.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import parse_ranks, read_ranks
from .common import table

PACK_TOKENS = 2048
CHUNK_TOKENS = 1 << 21
#: Rows of the id matrix in one Arrow batch.
BATCH_PACKS = 256


class CapacityTree:
    """Open packs by room left; a segment tree counts the packs below each node."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.count = [0] * (2 * self.base)
        self.packs: dict[int, list[int]] = {}

    def add(self, room: int, pack: int) -> None:
        self.packs.setdefault(room, []).append(pack)
        node = self.base + room
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, pack) of least room >= need."""
        count, node = self.count, self.base + need
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.base
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.packs[room].pop()


def best_fit_decreasing(lengths: list[int], most: int) -> list[list[int]]:
    """Indexes of the pieces in each pack; every length is 1..most."""
    tree, packs = CapacityTree(most), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = most, len(packs)
            packs.append([])
        room, pack = found
        packs[pack].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], pack)
    return packs


_WORKER: dict = {}


def _tokenizer(ranks: bytes, pattern: str):
    key = hash(ranks), pattern
    if key not in _WORKER:
        import tiktoken

        _WORKER[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=parse_ranks(ranks), special_tokens={})
    return _WORKER[key]


_SCHEMA = "pack_id long, n_tokens int, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids binary, positions binary"


def pack_documents(docs: DataFrame, ranks: bytes, pattern: str, eos: int, *, length: int = PACK_TOKENS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Packs: pack_id, n_tokens, doc_ids and pieces of the segments, cu_seqlens, ids and positions.

    ids and positions are little-endian int32 rows of ``length``; past n_tokens
    ids hold ``eos`` and positions 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def packed(segments: list, first: int) -> Iterator[pa.RecordBatch]:
        packs = best_fit_decreasing([len(s[2]) for s in segments], length)
        for at in range(0, len(packs), BATCH_PACKS):
            some = packs[at : at + BATCH_PACKS]
            ids = np.full((len(some), length), eos, "<i4")
            positions = np.zeros((len(some), length), "<i4")
            ends, owners, pieces = [], [], []
            for row, members in enumerate(some):
                end = 0
                cut = [0]
                for m in members:
                    own = segments[m][2]
                    ids[row, end : end + len(own)] = own
                    positions[row, end : end + len(own)] = np.arange(len(own))
                    end += len(own)
                    cut.append(end)
                ends.append(cut)
                owners.append([segments[m][0] for m in members])
                pieces.append([segments[m][1] for m in members])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first + at, first + at + len(some)), pa.int64()),
                    pa.array([c[-1] for c in ends], pa.int32()),
                    pa.array(owners, pa.list_(pa.int64())),
                    pa.array(pieces, pa.list_(pa.int32())),
                    pa.array(ends, pa.list_(pa.int32())),
                    pa.array([r.tobytes() for r in ids], pa.binary()),
                    pa.array([r.tobytes() for r in positions], pa.binary()),
                ],
                ["pack_id", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "ids", "positions"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(shared.value, pattern).encode_to_numpy
        first = TaskContext.get().partitionId() << 40
        segments, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or "", disallowed_special=()), np.uint32(eos))
                segments += [(doc, p, ids[b : b + length]) for p, b in enumerate(range(0, len(ids), length))]
                held += len(ids)
                if held >= chunk_tokens:
                    yield from packed(segments, first)
                    first += (len(segments) >> 20) + 1 << 20
                    segments, held = [], 0
        yield from packed(segments, first)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def unpack(packs: DataFrame) -> DataFrame:
    """doc_id, piece and ids (array<int>) of every segment: the documents' ids back, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, cut = np.frombuffer(row["ids"], "<i4"), row["cu_seqlens"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["pieces"], pa.int32()), pa.array([ids[b:e] for b, e in zip(cut, cut[1:], strict=False)], pa.list_(pa.int32()))],
                    ["doc_id", "piece", "ids"],
                )

    return packs.select("doc_ids", "pieces", "cu_seqlens", "ids").mapInArrow(run, "doc_id long, piece int, ids array<int>")


def write_packs(packs: DataFrame, path: str) -> None:
    """Files of the packed matrix: one row per pack, ids and positions as fixed-length binary."""
    packs.write.mode("overwrite").parquet(path)


def query(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    packs = pack_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, 50256)
    return packs.select(
        "pack_id", "n_tokens", F.size("doc_ids").alias("n_segments"), "doc_ids", "pieces", "cu_seqlens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"),
    )
