"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash is a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and the signed axis
that is nearest to the turned unit vector. Every vector lives in one bucket of each table; a query visits those of the
axes that are nearest to it in turn. In its bucket it is compared with all that live there, and the best of each visit
are measured exactly, on the original vectors in double precision. Residents and visitors meet by a shuffle: tables,
buckets and lengths are the key, and a bucket with many residents is cut into chunks that each visitor goes to.

A query that finds fewer than it should visits every bucket of one table, which is to be compared with everything.

Defined cases: vectors that are null, zero, or with null or non-finite components take no part, nor do rows without id;
vectors of different length are not compared; rows that share an id are one item, as near as its nearest vector, and
not its own neighbour; of equal vectors those with the smallest ids are all that can be among the nearest; an empty
table gives an empty result; other columns are not needed and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Hash tables, buckets of each that a query visits, neighbours of a query.
TABLES, PROBES, NEAREST = 8, 16, 5
#: Residents of one chunk, and vectors that are hashed or compared with a chunk at once.
CHUNK, STRIP = 8192, 2048
#: Slack of products, which may differ in their last digits with the shape of the matrices.
LOOSE = 1e-9
#: More than the buckets of a table.
_BUCKETS = 1 << 24


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Hadamard transform of rows whose length is a power of two, up to a factor."""
    size, half = x.shape[1], 1
    while half < size:
        pairs = x.reshape(len(x), -1, 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), size)
        half *= 2
    return x


def turned(unit: np.ndarray, number: int) -> np.ndarray:
    """Vectors under the pseudo-rotation of a table; lengths that are no power of two are filled up with zeros."""
    size = 1 << max(unit.shape[1] - 1, 0).bit_length()
    x = np.zeros((len(unit), size))
    x[:, : unit.shape[1]] = unit
    for signs in np.random.default_rng([number, size]).choice([-1.0, 1.0], (3, size)):
        x = hadamard(x * signs) / np.sqrt(size)
    return x


def nearest_axes(x: np.ndarray, many: int) -> np.ndarray:
    """Numbers of the nearest signed axes, nearest first: 2 i for axis i, one more for its opposite."""
    signed = np.stack([x, -x], 2).reshape(len(x), -1)
    many = min(many, signed.shape[1])
    if many == 1:
        return signed.argmax(axis=1)[:, None]
    some = np.argpartition(-signed, many - 1, axis=1)[:, :many]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(signed, some, 1), axis=1, kind="stable"), 1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which changes no angle and no digit, so that squares stay in range."""
    vectors = vectors.astype(np.float64)
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def unit(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices, in double precision."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _strips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of vectors of one length. Input: id, embedding."""
    for batch in batches:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths).tolist():
            mine = batch.filter(pa.array(lengths == size))
            for start in range(0, mine.num_rows, STRIP):
                yield size, mine.slice(start, STRIP)


def _homes(tables: int):
    """(size, bucket) of every vector in every table, counted within a strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, strip in _strips(batches):
            x = unit(_matrix(strip.column(1)))
            homes = np.concatenate([t * _BUCKETS + nearest_axes(turned(x, t), 1)[:, 0] for t in range(tables)])
            number, count = np.unique(homes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), size, np.int32)), pa.array(number), pa.array(count)], ["size", "bucket", "n"])

    return run


def _dealt(tables: int, probes: int, parts: dict[tuple[int, int], int], visitor: int):
    """Rows for the chunks of buckets that a vector lives in (visitor 0) or visits (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for size, strip in _strips(batches):
            ids, x = strip.column(0).to_numpy(), unit(_matrix(strip.column(1)))
            for t in range(tables):
                axes = nearest_axes(turned(x, t), probes if visitor else 1)
                row, bucket = np.repeat(np.arange(len(x)), axes.shape[1]), t * _BUCKETS + axes.ravel()
                chunks = np.array([parts.get((size, b), 1) for b in bucket.tolist()], np.int64)
                if visitor:
                    row, bucket = np.repeat(row, chunks), np.repeat(bucket, chunks)
                    chunk = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                else:
                    chunk = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), size, np.int32)), pa.array(bucket), pa.array(chunk), pa.array(np.full(len(row), visitor, np.int8)), strip.column(0).take(taken), strip.column(1).take(taken)],
                    ["size", "bucket", "chunk", "visitor", "id", "embedding"],
                )

    return run


def _best(nearest: int):
    """(query, vec, score) of each visit's nearest, from rows sorted by size, bucket and chunk with residents first."""

    def compare(homes: tuple[np.ndarray, ...], ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        own, raw, whole = homes
        near = unit(vectors) @ whole.T
        near[ids[:, None] == own[None]] = -2
        many = min(nearest, near.shape[1])
        least = np.partition(near, near.shape[1] - many, axis=1)[:, near.shape[1] - many]
        i, j = np.nonzero((near >= least[:, None] - LOOSE) & (near > -2))
        score = np.concatenate([cosines(vectors[i[a : a + 100_000]], raw[j[a : a + 100_000]]) for a in range(0, max(len(i), 1), 100_000)])
        order = np.lexsort((own[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.searchsorted(i, i)
        kept = np.arange(len(i)) - first < many
        return pa.RecordBatch.from_arrays([pa.array(ids[i[kept]]), pa.array(own[j[kept]]), pa.array(score[kept])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, homes = None, [], None
        for batch in batches:
            sizes, buckets, chunks, visitor = (batch.column(k).to_numpy() for k in range(4))
            new = np.zeros(len(sizes), bool)
            for x in (sizes, buckets, chunks, visitor):
                new[1:] |= x[1:] != x[:-1]
            edges = [*(np.flatnonzero(new).tolist()), len(sizes)] if len(sizes) else []
            a = 0
            for b in edges:
                key = (int(sizes[a]), int(buckets[a]), int(chunks[a]))
                if key != of:
                    of, held, homes = key, [], None
                if not visitor[a]:
                    held.append(batch.slice(a, b - a))
                elif held:
                    if homes is None:
                        both = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        raw = _matrix(both.column("embedding"))
                        homes = (both.column("id").to_numpy(), raw, unit(raw))
                    for s in range(a, b, STRIP):
                        strip = batch.slice(s, min(STRIP, b - s))
                        yield compare(homes, strip.column("id").to_numpy(), _matrix(strip.column("embedding")))
                a = b

    return run


def _found(residents: DataFrame, queries: DataFrame, tables: int, probes: int, nearest: int) -> DataFrame:
    """(query_id, vec_id, score) of what the queries meet, the nearest of each visit."""
    # A count for each bucket that is to be cut.
    full = residents.mapInArrow(_homes(tables), "size int, bucket long, n long").groupBy("size", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > CHUNK).collect()
    parts = {(r["size"], r["bucket"]): -(-r["n"] // CHUNK) for r in full}
    form = f"size int, bucket long, chunk long, visitor byte, id long, embedding {dict(residents.dtypes)['embedding']}"
    rows = residents.mapInArrow(_dealt(tables, 1, parts, 0), form).unionByName(queries.mapInArrow(_dealt(tables, probes, parts, 1), form))
    key = ["size", "bucket", "chunk"]
    return rows.repartition(*key).sortWithinPartitions(*key, "visitor").mapInArrow(_best(nearest), "query_id long, vec_id long, score double")


def _nearest(found: DataFrame, nearest: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(df: DataFrame, asked: Column, ident: str = "vec_id", vector: str = "embedding", nearest: int = NEAREST, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is asked for, the nearest other rows that were found.

    More tables or probes find more of the true neighbours and compare more.
    """
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.coalesce(asked, F.lit(False)).alias("asked"))
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    fit = checkpoint(rows.where(sound & F.col("vec_id").isNotNull()).groupBy("vec_id", "embedding").agg(F.max("asked").alias("asked")))
    # Of equal vectors, as many as a query can return besides itself: Spark limits them before they are shuffled.
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    residents = checkpoint(fit.withColumn("nth", nth).where(F.col("nth") <= nearest + 1).select("vec_id", "embedding"))
    queries = fit.where("asked").select("vec_id", "embedding")
    found = checkpoint(_nearest(_found(residents, queries, tables, probes, nearest), nearest))
    # Those that found too few are compared with all.
    enough = found.where(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"))
    short = queries.join(enough, "vec_id", "left_anti")
    if short.isEmpty():
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    rest = _nearest(_found(residents, short, 1, _BUCKETS, nearest), nearest)
    out = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(rest)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11_cross_polytope: the five nearest vectors of every fiftieth id, among all."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
