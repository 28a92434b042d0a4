"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of cosine c are sqrt(2 - 2c) apart. After a random rotation the vector is cut into blocks; two vectors
within the limit are within its proportional share in at least one block. Each block is joined by range: a bounded
sample gives centres, a vector lives in the cell of its nearest centre and visits every other cell that may hold a
partner (a bound by the plane between two centres, so no partner is missed). In its cell a vector is compared with
all others there, in the block first; what is near enough there is verified with whole vectors in double precision.
A link counts in the first block that has it, so the blocks together count each once.

Equal vectors are one class from the start. Cells with many residents are cut into chunks. Tasks return counts and
spanning forests, never pairs.

Vectors of each length are joined among themselves, in the same shuffles; lengths that are not in the sample have one
cell for all.

Defined cases: vectors that are null, zero, or with null or non-finite components link with nothing and are their own
component, and so do those without id; vectors of different length don't link; repeated rows are other vectors to each other; an empty table gives an
empty result; other columns are not needed and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table
from .components import connected_components, forest

#: Components of one block.
BLOCK = 16
#: Vectors that the centres are drawn from, at most; residents of one chunk; vectors compared with a chunk at once.
SAMPLE, CHUNK, STRIP = 4096, 8192, 2048
#: A cell for about so many vectors, within these bounds.
CELL, LEAST_CELLS, MOST_CELLS = 6000, 4, 1024
#: Slack of comparisons in single precision, and of distances in double precision.
LOOSE, TIGHT = 1e-4, 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotation(size: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def blocks_of(size: int) -> list[slice]:
    return [slice(a, min(a + BLOCK, size)) for a in range(0, size, BLOCK)]


class Cells:
    """Of vectors of one length: centres of every block, and the part of the squared distance that each block may take."""

    def __init__(self, size: int, cosine: float, sample: np.ndarray | None = None) -> None:
        self.size, self.cosine, self.turn, self.blocks = size, cosine, rotation(size), blocks_of(size)
        # A proportional share: blocks may differ in size.
        self.budgets = [(2 - 2 * cosine) * (b.stop - b.start) / size for b in self.blocks]
        centres = np.zeros((1, size)) if sample is None else unit(sample) @ self.turn
        self.centres = [centres[:, b] for b in self.blocks]

    @staticmethod
    def of(samples: dict[int, np.ndarray], cosine: float) -> Callable[[int], Cells]:
        """The cells of each length, made when they are first needed."""
        return lru_cache(maxsize=64)(lambda size: Cells(size, cosine, samples.get(size)))

    def visits(self, turned: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block: rows, cells, and whether the row lives there."""
        for k, b in enumerate(self.blocks):
            c, x = self.centres[k], turned[:, b]
            far = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
            home = far.argmin(axis=1)
            between = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * c @ c.T, 0))[home]
            # The distance to the plane between the two centres is at most the distance to anything behind it.
            near = far - far[np.arange(len(x)), home][:, None] <= 2 * between * (np.sqrt(self.budgets[k]) + TIGHT) + TIGHT
            near[np.arange(len(x)), home] = True
            row, cell = np.nonzero(near)
            yield k, row, cell, cell == home[row]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of at most STRIP vectors of one length. Input: rep, embedding, copies."""
    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths).tolist():
        mine = batch.filter(pa.array(lengths == size))
        for start in range(0, mine.num_rows, STRIP):
            yield size, mine.slice(start, STRIP)


def _homes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_of = Cells.of(*shared.value)
        for batch in batches:
            for size, piece in _by_size(batch):
                cells = cells_of(size)
                for k, _, cell, home in cells.visits(unit(_matrix(piece.column(1))) @ cells.turn):
                    number, count = np.unique(cell[home], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(number), size, np.int32)), pa.array(k * MOST_CELLS + number), pa.array(count)], ["size", "cell", "n"])

    return run


def _visit(shared, parts: dict[tuple[int, int], int]):
    """Rows for each chunk of each cell that a vector lives in or visits; residents of a chunk first (visitor 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_of = Cells.of(*shared.value)
        for batch in batches:
            for size, piece in _by_size(batch):
                cells = cells_of(size)
                ident = piece.column(0).to_numpy()
                for k, row, cell, home in cells.visits(unit(_matrix(piece.column(1))) @ cells.turn):
                    number = k * MOST_CELLS + cell
                    chunks = np.array([parts.get((size, x), 1) for x in number.tolist()], np.int64)
                    mine = np.where(home, (ident[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks, -1)
                    every = np.repeat(np.arange(len(row)), chunks)
                    chunk = np.arange(len(every)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                    lives = np.flatnonzero(home)
                    keys = np.r_[number[every] * (1 << 32) + chunk, number[lives] * (1 << 32) + mine[lives]]
                    rows = np.r_[row[every], row[lives]]
                    visitor = np.r_[np.ones(len(every), np.int8), np.zeros(len(lives), np.int8)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys), pa.array(visitor), *(piece.column(i).take(pa.array(rows)) for i in range(3))], ["size", "key", "visitor", "rep", "embedding", "copies"])

    return run


def _link(shared):
    """Counts (v null) and links of residents, from rows sorted by length and key with residents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells_of = Cells.of(*shared.value)
        of, held = None, []
        residents: tuple | None = None

        def compare(strip: pa.RecordBatch) -> pa.RecordBatch | None:
            nonlocal residents
            size, key = of
            cells = cells_of(size)
            turn, blocks = cells.turn, cells.blocks
            if residents is None:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                raw = unit(_matrix(whole.column("embedding")))
                residents = (whole.column("rep").to_numpy(), raw, raw @ turn)
            ids, raw, turned = residents
            k = (key >> 32) // MOST_CELLS
            other = unit(_matrix(strip.column("embedding")))
            other_turned, other_ids, copies = other @ turn, strip.column("rep").to_numpy(), strip.column("copies").to_numpy()
            x, y = turned[:, blocks[k]], other_turned[:, blocks[k]]
            # Squared distances as one product: (x, |x|^2, 1) by (-2y, 1, |y|^2).
            x = np.hstack([x, (x * x).sum(1, keepdims=True), np.ones((len(x), 1))]).astype(np.float32)
            y = np.hstack([-2 * y, np.ones((len(y), 1)), (y * y).sum(1, keepdims=True)]).astype(np.float32)
            flat = np.flatnonzero(x @ y.T <= np.float32(cells.budgets[k] + LOOSE))
            i, j = flat // len(y), flat % len(y)
            us, vs, ns = [], [], []
            for a in range(0, len(i), 200_000):
                p, q = i[a : a + 200_000], j[a : a + 200_000]
                apart = (turned[p] - other_turned[q]) ** 2
                shares = np.stack([apart[:, b].sum(axis=1) <= cells.budgets[n] + TIGHT for n, b in enumerate(blocks)], 1)
                # The first block within its share counts the link.
                good = shares[:, k] & ~shares[:, :k].any(axis=1) & (ids[p] != other_ids[q])
                p, q = p[good], q[good]
                good = (raw[p] * other[q]).sum(axis=1) >= cells.cosine
                us.append(p[good])
                vs.append(other_ids[q[good]])
                ns.append(copies[q[good]])
            if not us or not sum(map(len, us)):
                return None
            u, v, n = np.concatenate(us), np.concatenate(vs), np.concatenate(ns)
            counts = np.bincount(u, n, len(ids)).astype(np.int64)
            some = np.flatnonzero(counts)
            f, g = forest(ids[u], v)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[ids[some], f]), pa.array(np.r_[np.zeros(len(some), np.int64), g], mask=np.r_[np.ones(len(some), bool), np.zeros(len(f), bool)]), pa.array(np.r_[counts[some], np.zeros(len(f), np.int64)])], ["u", "v", "n"])

        for batch in batches:
            sizes, keys, visitor = (batch.column(i).to_numpy() for i in range(3))
            edges = np.flatnonzero(np.r_[True, (sizes[1:] != sizes[:-1]) | (keys[1:] != keys[:-1]) | (visitor[1:] != visitor[:-1])]) if len(keys) else []
            for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
                if (int(sizes[a]), int(keys[a])) != of:
                    of, held, residents = (int(sizes[a]), int(keys[a])), [], None
                if not visitor[a]:
                    held.append(batch.slice(a, b - a))
                elif held:
                    for s in range(a, b, STRIP):
                        if (out := compare(batch.slice(s, min(STRIP, b - s)))) is not None:
                            yield out

    return run


def embedding_links(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(ident, n_links, component_id, kept) for each vector."""
    rows = df.select(F.col(ident).alias("vec_id"), F.col(vector).alias("embedding"))
    sound = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    fit = rows.where(sound & F.col("vec_id").isNotNull())
    classes = checkpoint(fit.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    vectors = classes.select("rep", "embedding", "copies")
    drawn: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").collect():
        drawn.setdefault(len(r[0]), []).append(r[0])
    # Of the lengths in the sample only, so at most SAMPLE rows.
    sizes = {r["size"]: r["count"] for r in vectors.groupBy(F.size("embedding").alias("size")).count().where(F.col("size").isin(list(drawn))).collect()}
    samples = {n: np.array(x[: min(MOST_CELLS, max(LEAST_CELLS, sizes[n] // CELL))], np.float64) for n, x in drawn.items()}
    shared = df.sparkSession.sparkContext.broadcast((samples, cosine))  # at most SAMPLE vectors
    # One count for each full cell: a number of rows bounded by blocks and MOST_CELLS.
    homes = vectors.mapInArrow(_homes(shared), "size int, cell long, n long").groupBy("size", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > CHUNK).collect()
    parts = {(r["size"], r["cell"]): -(-r["n"] // CHUNK) for r in homes}
    visits = vectors.mapInArrow(_visit(shared, parts), f"size int, key long, visitor byte, rep long, embedding {dict(classes.dtypes)['embedding']}, copies long")
    found = checkpoint(visits.repartition("size", "key").sortWithinPartitions("size", "key", "visitor").mapInArrow(_link(shared), "u long, v long, n long"))
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    components = connected_components(found.where("v is not null").select("u", "v"))
    named = classes.join(counts, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    named = named.select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named, "embedding", "left")
    mine = F.col("vec_id").isNotNull()
    component = F.when(mine, F.coalesce("component_id", "vec_id"))
    return out.select(F.col("vec_id").alias(ident), F.when(mine, F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2_subspace_embeddings: links and component of every vector."""
    return embedding_links(table(spark, sf_dir, "embeddings"))
