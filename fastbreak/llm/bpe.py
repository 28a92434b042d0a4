"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into pieces by the vocabulary's pattern. New pieces of a batch go, bucketed by length, into padded
matrices of token ids. In every round each row merges its leftmost pair of minimum rank, found by a hashed pair
table, and is compacted; rows without a mergeable pair leave the matrix. The work is per row of the input, so no
shuffle is needed and a lost executor costs only its own partitions. Pieces already seen by a Python worker are
kept in a bounded table.

Defined cases: a null or empty text has no ids; every byte is a token, so any text encodes; repeated rows are
encoded alike; other columns pass through, and an existing column named as the output is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_CHARS, slices, table, texts

#: No rank: larger than any.
NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this are merged one by one with a heap (O(n log n)) and not in a matrix.
WIDEST = 512
#: Pieces that a worker remembers before it starts over.
REMEMBERED = 600_000


class PairTable:
    """(left id, right id) -> (rank, merged id), by open addressing in numpy."""

    def __init__(self, left, right, rank, merged) -> None:
        keys = (np.asarray(left, np.uint64) << np.uint64(32)) | np.asarray(right, np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, NONE, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        left_over, slot = np.arange(len(keys)), self._home(keys)
        while len(left_over):
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            won = np.zeros(len(slot), bool)
            won[first] = True
            won &= free
            at, which = slot[won], left_over[won]
            self.keys[at], self.ranks[at], self.merged[at] = keys[which], np.asarray(rank, np.int32)[which], np.asarray(merged, np.int32)[which]
            left_over, slot = left_over[~won], (slot[~won] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty slot (rank NONE) where there is none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._home(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != np.uint64(2**64 - 1))]
        return slot


def merge_all(symbols: list[np.ndarray], pairs: PairTable) -> list[np.ndarray]:
    """Merge every sequence of ids as far as it goes."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(symbols)
    lengths = np.fromiter(map(len, symbols), np.int64, len(symbols))
    for i in np.flatnonzero(lengths > WIDEST):
        out[i] = _merge_long(symbols[i], pairs)
    for i in np.flatnonzero(lengths == 1):
        out[i] = symbols[i]
    width = 2
    while width <= WIDEST:
        bucket = np.flatnonzero((lengths > width // 2) & (lengths <= width) & (lengths > 1))
        step = max(1, 400_000 // width)
        for start in range(0, len(bucket), step):
            _merge_bucket(bucket[start : start + step], symbols, lengths, width, pairs, out)
        width *= 2
    return out


def _merge_bucket(rows, symbols, lengths, width, pairs, out) -> None:
    if not len(rows):
        return
    size = lengths[rows]
    ids = np.full((len(rows), width), -1, np.int32)
    inside = np.arange(width) < size[:, None]
    ids[inside] = np.concatenate([symbols[i] for i in rows])
    ranks = np.full((len(rows), width), NONE, np.int32)  # of the pair that starts at each place
    pair = inside[:, 1:]
    ranks[:, :-1][pair] = pairs.ranks[pairs.slots(ids[:, :-1][pair], ids[:, 1:][pair])]
    while len(rows):
        at = ranks.argmin(axis=1)
        every = np.arange(len(rows))
        done = ranks[every, at] == NONE
        if done.any():
            for k in np.flatnonzero(done):
                out[rows[k]] = ids[k, : size[k]].copy()
            keep = ~done
            rows, size, ids, ranks, at = rows[keep], size[keep], ids[keep], ranks[keep], at[keep]
            every = np.arange(len(rows))
            if not len(rows):
                return
        ids[every, at] = pairs.merged[pairs.slots(ids[every, at], ids[every, at + 1])]
        # Compaction: drop the right half of the pair.
        columns = np.arange(width - 1)
        source = columns + (columns > at[:, None])
        ids[:, :-1] = np.take_along_axis(ids, source, 1)
        ids[:, -1] = -1
        ranks[:, :-1] = np.take_along_axis(ranks, source, 1)
        ranks[:, -1] = NONE
        size = size - 1
        for shift in (-1, 0):
            left = at + shift
            fits = np.flatnonzero((left >= 0) & (left + 1 < size))
            ranks[every, np.maximum(left, 0)] = np.where((left >= 0), NONE, ranks[every, 0])
            ranks[fits, left[fits]] = pairs.ranks[pairs.slots(ids[fits, left[fits]], ids[fits, left[fits] + 1])]


def _merge_long(symbols: np.ndarray, pairs: PairTable) -> np.ndarray:
    ids = symbols.tolist()
    n = len(ids)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def rank(i: int) -> tuple[int, int]:
        j = after[i]
        if j >= n:
            return int(NONE), -1
        slot = pairs.slots(np.array([ids[i]], np.int64), np.array([ids[j]], np.int64))[0]
        return int(pairs.ranks[slot]), int(pairs.merged[slot])

    first = pairs.slots(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64))
    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(pairs.ranks[first]) if r != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or ids[i] != left or ids[j] != right:
            continue
        ids[i] = rank(i)[1]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < n and (r := rank(k)[0]) != NONE:
                heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
    return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int32)


class RankedBpe:
    """A vocabulary of byte strings whose ids are their ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.bytes_of = {b: a for a, b in self.ranks.items()}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        splits = [(left, right, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*splits, strict=True))
        self.pairs = PairTable(left, right, rank, rank)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, batch: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        pieces = [self.find(text) for text in batch]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        new = list({p for row in pieces for p in row if p not in known})
        raw = [p.encode("utf-8", "surrogatepass") for p in new]
        whole = [self.ranks.get(r) for r in raw]
        hard = [i for i, w in enumerate(whole) if w is None]
        merged = merge_all([self.single[np.frombuffer(raw[i], np.uint8)] for i in hard], self.pairs)
        known.update((new[i], w.to_bytes(4, "little")) for i, w in enumerate(whole) if w is not None)
        known.update((new[i], ids.astype("<u4").tobytes()) for i, ids in zip(hard, merged, strict=True))
        return [b"".join(map(known.__getitem__, row)) for row in pieces]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> RankedBpe:
    """Loaded once in each Python worker."""
    return RankedBpe(path, pattern)


def byte_bpe(df: DataFrame, text: str = "text", out: str = "bpe", path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """Add the struct column `out`: the ids of each text and the bytes that they decode to.

    With digests, the struct holds their number, the SHA-256 of the ids and of the decoded bytes instead.
    """
    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary"
    names = [x.split()[0] for x in kind.split(", ")]

    @F.arrow_udf(f"struct<{kind.replace(' ', ':')}>".replace(",:", ","))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for part in slices(texts(batch), limit=SLICE_CHARS):
                for ids in bpe.encode(part):
                    back = bpe.decode(ids)
                    row = (len(ids) // 4, sha256(ids).hexdigest(), sha256(back).hexdigest()) if digests else (np.frombuffer(ids, "<u4").astype(np.int32), back)
                    for column, value in zip(columns, row, strict=True):
                        column.append(value)
            types = (pa.int64(), pa.string(), pa.string()) if digests else (pa.list_(pa.int32()), pa.binary())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return df.withColumn(out, encode(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_byte_bpe: ids and decoded bytes of every document, as digests."""
    return byte_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True).select("doc_id", "bpe.*")
