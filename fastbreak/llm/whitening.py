"""Whitening of embeddings by the leading components of their covariance.

The covariance is never formed. Chebyshev-filtered subspace iteration holds a thin block Q, a few columns wider than the
components that are wanted; every step is one pass over the centred rows that sums X'(XQ) task by task. A polynomial
recurrence over such passes damps the spectrum below the block's smallest Ritz value, then QR and a Rayleigh-Ritz step
turn the block into components. Rounds end when the residual of each wanted component is certified to be rounding
error, by a pass over all rows.

Rows are whole numbers x, floor(64 c) + 1000000: sums and deviations are exact, and a row is centred by an exact
difference before anything is multiplied. The driver holds Q and sums of Q's shape, never rows.

Defined cases: rows whose vector is null, or holds a null, a non-finite entry, or one whose x is beyond 2**52, are left
out; vectors of each length are fitted on their own; a row without id is whitened too, and repeated rows count each;
zero vectors count; vectors without entries have no components; a component without variance has a null `whitened`
and is no part of `identity_error`; a deviation beyond a long is null; an empty table gives an empty result; other
columns are not needed and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

#: Components that are returned, columns of the block beside them, passes of one round.
COMPONENTS, GUARD, DEGREE = 32, 16, 12
#: Residual of a certified component, in the largest eigenvalue and for one dimension.
RESIDUAL = 2e-15
#: What an entry is multiplied by, and what is added.
SCALE, SHIFT = 64, 1_000_000
#: Rounds after which something must be wrong.
ROUNDS = 500
_ROWS = 4096
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Centred:
    """Rows of one length as (vec_id, x), their number and sums, and passes over them."""

    def __init__(self, rows: DataFrame, size: int) -> None:
        self.rows, self.size = rows, size
        sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
        self.n, self.sums = sums[0]["n"], [int(r["s"]) for r in sums]
        # The mean as a whole number and the rest of it, so that x - whole is exact.
        self.whole, self.rest = np.array([s // self.n for s in self.sums], np.int64), np.array([s % self.n / self.n for s in self.sums])

    def summed(self, measure, height: int, width: int) -> np.ndarray:
        """The sum over all rows of what measure(centred rows) returns, a matrix of the given shape."""
        whole, rest = self.whole, self.rest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for c in centred(batch.column(0), whole, rest):
                    total = measure(c) if total is None else total + measure(c)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(height, dtype=np.int32)), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(width))], ["i", *(f"q{j}" for j in range(width))])

        form = "i int, " + ", ".join(f"q{j} double" for j in range(width))
        found = self.rows.select("x").mapInArrow(run, form).groupBy("i").agg(*(F.sum(f"q{j}").alias(f"q{j}") for j in range(width))).collect()
        out = np.zeros((height, width))
        for r in found:
            out[r["i"]] = r[1:]
        return out

    def product(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q."""
        return self.summed(lambda c: c.T @ (c @ q), self.size, q.shape[1]) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda c: (c * c).sum(axis=0)[:, None], self.size, 1).sum()) / self.n


def centred(column: pa.Array, whole: np.ndarray, rest: np.ndarray) -> Iterator[np.ndarray]:
    """x less the mean, some rows at a time."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(whole))
    for a in range(0, len(x), _ROWS):
        yield (x[a : a + _ROWS] - whole) - rest


def _ritz(q: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values falling, the block turned to them, and the covariance times it; y: the covariance times q."""
    h = q.T @ y
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, y @ turn


def components(product, size: int, wanted: int, guard: int = GUARD, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """The wanted largest eigenvalues, falling, and their unit eigenvectors as columns; product(q) is one pass."""
    width = min(size, wanted + guard)
    q, _ = np.linalg.qr(np.random.default_rng(size).standard_normal((size, width)))
    for _ in range(ROUNDS):
        values, q, y = _ritz(q, product(q))
        top = max(values[0], 0.0)
        residual = np.sqrt(((y - q * values) ** 2).sum(axis=0))[:wanted]
        if (residual <= RESIDUAL * size * top).all():
            return np.maximum(values[:wanted], 0), q[:, :wanted]
        # The interval from 0 to the smallest Ritz value is mapped to [-1, 1], where Chebyshev polynomials stay small;
        # above it they grow. They are scaled by their value at the largest Ritz value so that they stay in range.
        half = max(values[-1], top * 1e-9) / 2
        at = half / (top - half)
        scale = at
        before, now = q, (y - half * q) * (at / half)
        for _ in range(degree - 1):
            following = 1 / (2 / at - scale)
            before, now = now, (product(now) - half * now) * (2 * following / half) - scale * following * before
            scale = following
        q, _ = np.linalg.qr(now)
    raise ArithmeticError(f"components are not certified after {ROUNDS} rounds: {residual.max() / top:.1e}")


def _whiten(fit: Centred, values: np.ndarray, vectors: np.ndarray, explained: np.ndarray, error: float):
    n, sums, whole, rest = fit.n, fit.sums, fit.whole, fit.rest
    count = len(values)
    some = values > 0
    turn = vectors / np.sqrt(np.where(some, values, 1))
    most = 1 << 63

    def deviations(x: np.ndarray) -> list[int | None]:
        # In whole numbers of any size unless a bound says that they fit.
        reach = int(np.abs(x - whole).max(initial=0)) + 1
        if n * max(int(np.abs(x).max(initial=0)), max(map(abs, sums)) // n + 1) < most // 2 and (n * reach) ** 2 * len(sums) < most:
            d = n * x - np.array(sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
        return [v if v < most else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(sums))
            for a in range(0, len(x), _ROWS):
                piece = x[a : a + _ROWS]
                rows = len(piece)
                white = (((piece - whole) - rest) @ turn).ravel() if rows else np.zeros(0)
                repeat = pa.array(np.repeat(np.arange(a, a + rows), count))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(repeat), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)), pa.array(np.full(rows * count, n)),
                        pa.array(deviations(piece), pa.int64()).take(pa.array(np.repeat(np.arange(rows), count))), pa.array(white, mask=~np.tile(some, rows)),
                        pa.array(np.tile(explained, rows)), pa.array(np.full(rows * count, error)),
                    ],
                    [c.split()[0] for c in _OUT.split(", ")],
                )

    return run


def whiten(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Rows of _OUT for each vector and component, at most as many components as wanted or as the vectors are long."""
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)).alias("y"), F.col(vector).alias("c"))
    sound = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * SCALE < float(1 << 52))) & (F.size("c") > 0)
    rows = checkpoint(rows.where(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("y", lambda y: y + SHIFT).alias("x")))
    # As many jobs as there are lengths.
    sizes = sorted(r[0] for r in rows.select(F.size("x")).distinct().collect())
    out = rows.sparkSession.createDataFrame([], _OUT)
    for size in sizes:
        fit = Centred(rows.where(F.size("x") == size), size)
        values, vectors = components(fit.product, size, min(wanted, size))
        trace = fit.trace()
        # What rounding leaves of a variance of nothing.
        values = np.where(values > size * np.finfo(float).eps * values[0], values, 0) if trace else np.zeros_like(values)
        some = values > 0
        turn = vectors[:, some] / np.sqrt(values[some])
        error = 0.0
        if some.any():
            # Products and sums of what is returned, over all rows.
            both = fit.summed(lambda c, turn=turn: np.vstack([(w := c @ turn).T @ w, w.sum(axis=0)]), turn.shape[1] + 1, turn.shape[1]) / fit.n
            error = float(np.abs(both[:-1] - np.outer(both[-1], both[-1]) - np.eye(len(both) - 1)).max())
        explained = values / trace if trace else np.zeros_like(values)
        out = out.unionByName(fit.rows.mapInArrow(_whiten(fit, values, vectors, explained, error), _OUT))
    return out.withColumnRenamed("vec_id", ident)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13_chebyshev_whitening: up to 32 components of every vector."""
    return whiten(table(spark, sf_dir, "embeddings"))
