"""Byte-level BPE as a monoid tree reduction.

Encoded segments form a monoid: the element for a byte string is its token
list, and the product of two lists is the token list of the joined string.
``TreeBpe.encode_bytes`` halves a string until a piece is small, encodes the
pieces and multiplies up the tree.  A product re-encodes only a window around
the seam.  The window grows by doubling until the token pair on each of its
borders is *stable*: encoding the two tokens' bytes alone gives the same two
tokens.  Merges happen in rank order and a first merge across a border would
also happen in the string made of the two neighbouring tokens alone, so a list
whose neighbouring pairs are all stable is the encoding of its text.  Pairs
inside either half are stable already; only the borders need a test.

A token whose own bytes merge to something else (it cannot be reached) is the
encoding of a whole piece of text, as the library has it, but never of a segment
within one.  The driver looks for such tokens once.

Decoding is the free monoid: the bytes of the tokens, concatenated up a tree.

Defined cases: a null text counts as empty; an empty text has no ids and both
digests are those of nothing; ties and repeated rows are encoded each on its
own; a null ``doc_id`` stays null.  Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Distinct pieces of text whose ids one Python worker remembers.
MEMO_ENTRIES = 400_000
#: A string of at most this many bytes is a leaf of the tree.
LEAF_BYTES = 16


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """``token-in-base64 rank`` lines, the format of .tiktoken files."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, unreachable: frozenset[int] | None = None):
        import regex

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self._stable: dict[int, bool] = {}
        self.unreachable = self.find_unreachable() if unreachable is None else unreachable

    def find_unreachable(self) -> frozenset[int]:
        """Tokens of which the bytes, merged from the beginning, give other tokens."""
        return frozenset(i for t, i in self.ranks.items() if len(t) > 1 and self._merge(t) != [i])

    def _leaf(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None and whole not in self.unreachable else self._merge(data)

    def _merge(self, data: bytes) -> list[int]:
        """Merge the adjacent pair of lowest rank, the leftmost first."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], 1 << 60) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == 1 << 60:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], 1 << 60)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], 1 << 60)
        return [ranks[p] for p in parts]

    def stable(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > MEMO_ENTRIES:
                self._stable.clear()
            known = self._leaf(self.tokens[left] + self.tokens[right]) == [left, right]
            self._stable[key] = known
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The monoid product: the encoding of the two lists' joined bytes."""
        if not left or not right:
            return left or right
        if self.stable(left[-1], right[0]):
            return left + right
        tokens, width = self.tokens, 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            text = b"".join(map(tokens.__getitem__, left[a:] + right[:b]))
            middle = self._leaf(text) if len(text) <= 4 * LEAF_BYTES else self._split(text)
            ok_left = a == 0 or self.stable(left[a - 1], middle[0])
            ok_right = b == len(right) or self.stable(middle[-1], right[b])
            if ok_left and ok_right:
                return left[:a] + middle + right[b:]
            width *= 2

    def _split(self, text: bytes) -> list[int]:
        """A wide window: heap-ordered merges, so that long runs stay near linear."""
        import heapq

        ranks, n = self.ranks, len(text)
        start, end = list(range(n)), list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, middle, stop = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or end[i] != middle or j < 0 or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := ranks.get(text[start[p] : end[q]])) is not None:
                    heapq.heappush(heap, (r, p, end[p], end[q]))
        out, i = [], 0
        while i >= 0:
            out.append(ranks[text[start[i] : end[i]]])
            i = after[i]
        return out

    def encode_piece(self, data: bytes) -> list[int]:
        """The encoding of one match of the pattern: a token of its own, or the tree's."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode_bytes(data)

    def encode_bytes(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self._leaf(data)
        middle = len(data) // 2
        return self.join(self.encode_bytes(data[:middle]), self.encode_bytes(data[middle:]))

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.encode_piece(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class _Memo(dict):
    """Piece of text -> its ids as decimal text; emptied when it is full."""

    def __init__(self, bpe: TreeBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> str:
        ids = ",".join(map(str, self.bpe.encode_piece(piece.encode())))
        if len(piece) <= 64:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


_WORKER: dict[tuple[int, str], tuple[TreeBpe, _Memo, dict[str, bytes]]] = {}


def _worker(ranks: bytes, pattern: str, unreachable: frozenset[int]):
    key = (hash(ranks), pattern)
    if key not in _WORKER:
        bpe = TreeBpe(parse_ranks(ranks), pattern, unreachable)
        _WORKER[key] = bpe, _Memo(bpe), {str(i): t for i, t in bpe.tokens.items()}
    return _WORKER[key]


@functools.cache
def _unreachable(ranks: bytes, pattern: str) -> frozenset[int]:
    return TreeBpe(parse_ranks(ranks), pattern).unreachable


def _concat(parts: list[bytes]) -> bytes:
    """Bytes of a token list, joined up a tree of bounded fan-in."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + 4096]) for i in range(0, len(parts), 4096)]
    return parts[0] if parts else b""


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, *, with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Encode ``text`` and decode the ids again.

    Adds n_tokens, ids_sha256 and decoded_sha256 to the columns ``keep`` (doc_id
    alone unless given), and, where asked for, ``ids`` as array<int>.  One pass
    without a shuffle; the vocabulary (under a megabyte) is broadcast.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    unreachable = _unreachable(ranks, pattern)
    kept = [f for f in docs.schema.fields if f.name in keep]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    ddl += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, memo, spelled = _worker(shared.value, pattern, unreachable)
        find = bpe.find
        for batch in batches:
            counts, digests, decoded, lists = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                line = ",".join(map(memo.__getitem__, find(text.as_py() or "")))
                ids = line.split(",") if line else []
                counts.append(len(ids))
                digests.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(_concat(list(map(spelled.__getitem__, ids)))).hexdigest())
                if with_ids:
                    lists.append(list(map(int, ids)))
            columns = [batch.column(i) for i in range(len(names))]
            columns += [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return docs.select(*[F.col(f"`{n}`") for n in names], F.col("text").alias("__text")).mapInArrow(run, ddl)


def decode_ids(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id and the text that the column ``ids`` stands for."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: t for t, i in parse_ranks(shared.value).items()}
        for batch in batches:
            texts = [_concat([tokens[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)
