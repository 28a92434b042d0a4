"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into three segments. Three differing bits leave at most one in at least two of the
segments. The binary Golay code (23 bits, 4096 codewords, every word within 3 of exactly one) turns a segment into
indices of nearby codewords: the decoded one, and for words at distance 3 also the five codewords at distance 4.
For words at most one bit apart, the decoded index of either is among the indices of the other. So every distinct
fingerprint gets keys (two segments' indices), rows with equal keys meet, and pairs are verified by their distance.
A key with very many fingerprints is split into cells. Each task returns links of a spanning forest, never all
pairs; equal fingerprints are one node from the start.

Defined cases: a null text is empty; an empty one has fingerprint 0 and is linked like any other; equal rows share
a component; a null id is kept and never names a component unless its whole group has none; other columns are not
needed and not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, run_bounds, slices, spread, table, texts, tidy, whole_runs
from .components import connected_components, forest

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints of one key that one cell compares; more are split.
CELL = 4096
#: Pairs that are verified at once.
PAIRED = 500_000
#: Keys with more fingerprints than a cell takes: up to so many are broadcast, beyond that they are joined by shuffle.
HOT_KEYS = 50_000


# ---------------------------------------------------------------- fingerprints


def fingerprints(batch: list[str], words: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text over its word shingles, repeats included."""
    hash_of = xxhash.xxh64_intdigest
    hashes: list[int] = []
    counts = []
    for text in batch:
        parts = text.encode("utf-8", "surrogatepass").lower().split()
        if len(parts) < words:
            hashes += [hash_of(b" ".join(parts), seed)] if parts else []
            counts.append(min(1, len(parts)))
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        firsts = [0, *(ends[: -words] + 1).tolist()]
        hashes += [hash_of(joined[a:b], seed) for a, b in zip(firsts, ends[words - 1 :].tolist(), strict=True)]
        counts.append(len(firsts))
    n = np.array(counts, np.int64)
    out = np.zeros(len(batch), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8)).reshape(-1, 64)
        votes = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(votes * 2 > n[some, None], axis=1).view(">u8").reshape(-1)
    return out


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3, seed: int = 42) -> DataFrame:
    """Add the long column `out`, the fingerprint's 64 bits."""

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [fingerprints(p, words, seed) for p in slices(texts(batch), limit=500_000)]
            yield pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64))

    return df.withColumn(out, run(F.col(text)))


# ---------------------------------------------------------------- Golay keys


@lru_cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decoded index of each 23-bit word; codeword of each index; row of each weight-3 error; its five other indices, as differences."""
    message = np.arange(4096)
    code = np.zeros(4096, np.int64)
    for k in range(12):
        code ^= np.where(message >> k & 1, GOLAY << k, 0)
    errors = np.array([sum(1 << b for b in bits) for w in range(4) for bits in combinations(range(23), w)])
    decoded = np.empty(1 << 23, np.int16)  # every word is hit once: the code is perfect
    for e in errors.tolist():
        decoded[code ^ e] = message
    sevens = np.flatnonzero(np.bitwise_count(code) == 7)
    places = np.full(1 << 23, -1, np.int16)
    triples = errors[np.bitwise_count(errors) == 3]
    places[triples] = np.arange(len(triples))
    near = np.array([sevens[(code[sevens] & t) == t] for t in triples.tolist()])
    return decoded, code, places, near


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[n, 6] indices of near codewords, the decoded one first, and [n, 6] which of them are there."""
    decoded, code, places, near = golay()
    first = decoded[words].astype(np.int64)
    error = words ^ code[first]
    three = np.bitwise_count(error) == 3
    out = np.repeat(first[:, None], 6, 1)
    out[three, 1:] ^= near[places[error[three]]]
    there = np.repeat(three[:, None], 6, 1)
    there[:, 0] = True
    return out, there


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key, and whether the key is of the decoded codewords, for all keys of the fingerprints."""
    found = [indices(((prints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    rows, keys, own = [], [], []
    for k, (i, j) in enumerate(PAIRS):
        key = (k << 24) | (found[i][0][:, :, None] << 12) | found[j][0][:, None, :]
        there = found[i][1][:, :, None] & found[j][1][:, None, :]
        row, a, b = np.nonzero(there)
        rows.append(row)
        keys.append(key[row, a, b])
        own.append((a == 0) & (b == 0))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(own)


def _emit(decoded_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                prints = batch.column(0).slice(start, 4000).to_numpy(zero_copy_only=False).view(np.uint64)
                row, key, own = keys_of(prints)
                if decoded_only:
                    row, key, own = row[own], key[own], own[own]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row].view(np.int64)), pa.array(own)], ["key", "print", "own"])

    return run


def _links(most: int):
    """Verified links of whole runs of equal keys: each row against those whose decoded key it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_runs(batches):
            key, prints = part.column("key").to_numpy(), part.column("print").to_numpy().view(np.uint64)
            own = part.column("own").to_numpy(zero_copy_only=False)
            starts, ends = run_bounds(key)
            mine = np.flatnonzero(own)
            first, past = np.searchsorted(mine, starts), np.searchsorted(mine, ends)
            run_of = np.repeat(np.arange(len(starts)), ends - starts)
            partners = (past - first)[run_of]
            u, v = [], []
            cuts = np.searchsorted(np.cumsum(partners), np.arange(0, partners.sum() + PAIRED, PAIRED), "left")
            for a, b in zip(cuts, np.r_[cuts[1:], len(key)], strict=True):
                row, place = spread(partners[a:b])
                x, y = prints[a:b][row], prints[mine[first[run_of[a:b]][row] + place]]
                good = (np.bitwise_count(x ^ y) <= most) & (x != y)
                a_, b_ = forest(x[good].view(np.int64), y[good].view(np.int64))
                u.append(a_)
                v.append(b_)
            u, v = forest(np.concatenate(u), np.concatenate(v)) if u else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _cells(keys: DataFrame, hot: DataFrame, hot_rows: int) -> DataFrame:
    """Split keys that too many fingerprints have: own ones by rows, all others by columns of a square of cells."""
    if not hot_rows:
        return keys
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("print"), parts)
    side = F.sequence(F.lit(0).cast("long"), parts - 1)
    # A decoded row is also compared as one of all rows, so it goes to a row and to a column of cells.
    wide = keys.join(F.broadcast(hot) if hot_rows <= HOT_KEYS else hot, "key", "left").select("key", "print", "own", parts.alias("parts"), mine.alias("mine"), F.explode(side).alias("other"))
    as_any = wide.select((F.col("key") + (F.col("other") * F.col("parts") + F.col("mine")) * (1 << 26)).alias("key"), "print", (F.col("own") & (F.col("mine") == F.col("other"))).alias("own"))
    as_own = wide.where("own and mine != other").select((F.col("key") + (F.col("mine") * F.col("parts") + F.col("other")) * (1 << 26)).alias("key"), "print", F.lit(True).alias("own"))
    return as_any.unionByName(as_own)


def fingerprint_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """(u, v): links between distinct fingerprints (column print: long) at most `most` <= 3 bits apart, as spanning forests."""
    if most > 3:
        raise ValueError("three segments find up to 3 differing bits")
    # Arrow batches follow the input; both uses compute the keys anew rather than store them.
    every = prints.mapInArrow(tidy(_emit(False)), "key long, print long, own boolean")
    decoded = prints.mapInArrow(tidy(_emit(True)), "key long, print long, own boolean")
    hot = checkpoint(decoded.groupBy("key").count().where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).alias("parts")))
    cells = _cells(every, hot, hot.count())
    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_links(most)), "u long, v long")


def _least_of_groups(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(print, least): for each fingerprint the smallest key of its group. rows: key, print."""
    nodes = rows.groupBy("print").agg(F.min(key).alias("least"))
    found = connected_components(fingerprint_links(nodes.select("print"), most))
    member = nodes.join(found, nodes["print"] == found["node"], "left").select("print", F.coalesce("component", "print").alias("root"), "least")
    roots = member.groupBy("root").agg(F.min("least").alias("least"))
    return member.select("print", "root").join(roots, "root").select("print", "least")


def simhash_groups(df: DataFrame, ident: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """(ident, fingerprint: 16 hex digits, component_id: smallest ident reachable by links) for each row."""
    # Names of its own: the given ones may be any.
    rows = df.select(F.col(f"`{ident}`").alias("key"), F.col(f"`{text}`").alias("said"))
    rows = checkpoint(with_fingerprint(rows, "said", "print").select("key", "print"))
    named = _least_of_groups(rows, "key", most)
    return rows.join(named, "print").select(F.col("key").alias(ident), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def smallest_of_groups(df: DataFrame, ident: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """df with one row of each group of near-duplicates.

    It is the one with the smallest id, rows without id coming last; of those with the same id the one whose text has
    the smallest hash; of those with the same id and text the smallest by all columns. So no row goes but for another
    one that stays and is linked to it.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    row = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names, strict=True)))
    at, said = names[df.columns.index(ident)], names[df.columns.index(text)]
    # Three columns name a row; none of them is null, so rows without id meet in joins as others do.
    named = row.select(F.col(at).isNull().alias("k0"), F.coalesce(F.col(at).cast("long"), F.lit(0).cast("long")).alias("k1"), F.xxhash64(said).alias("k2"), *names)
    key = F.struct("k0", "k1", "k2").alias("key")
    prints = checkpoint(with_fingerprint(named.select("k0", "k1", "k2", said), said, "print").select(key, "print"))
    least = _least_of_groups(prints, "key", most).select("least.*").distinct()
    kept = named.join(least, ["k0", "k1", "k2"], "left_semi")
    one = kept.groupBy("k0", "k1", "k2").agg(F.min(F.struct(*names)).alias("row"))
    return one.select(*(F.col(f"row.{n}").alias(c) for c, n in zip(df.columns, names, strict=True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_golay_simhash: fingerprint and near-duplicate component of every document."""
    return simhash_groups(table(spark, sf_dir, "documents"))
