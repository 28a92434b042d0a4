"""What the operators of this folder share: reading, slicing of Arrow batches, checkpoints, runs of sorted keys."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one slice of a batch holds, unless a single text is longer.
SLICE_CHARS = 2_000_000


#: Rows of an Arrow batch: texts are long, and a Python worker holds a batch several times over.
BATCH_ROWS = 1_500
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's own reader (any file system). Keeps the session's batches small."""
    if not 0 < int(spark.conf.get(_ROWS, "10000")) <= BATCH_ROWS:
        spark.conf.set(_ROWS, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for what the driver and all executors share; local sessions get one without it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (shared or tempfile.mkdtemp(prefix="checkpoint-")).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of what nothing refers to any more: shuffles that end in a checkpoint need no disk beyond it, but Spark
    drops their files only when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """The same function of batches; when it ends, what it has freed goes back to the system. Python workers are used
    again by later stages, and else each keeps the most memory that it ever had."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc has it
                trim(0)

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def texts(column: pa.Array) -> list[str]:
    """A column of strings as Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(items: list, weight=len, limit: int = SLICE_CHARS) -> Iterator[list]:
    """Consecutive slices of a list whose weights add up to the limit, each with one item at least."""
    start = total = 0
    for i, item in enumerate(items):
        w = weight(item)
        if i > start and total + w > limit:
            yield items[start:i]
            start, total = i, 0
        total += w
    if start < len(items):
        yield items[start:]


def whole_runs(batches: Iterable[pa.RecordBatch], key: str = "key", rows: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches that are sorted by the key."""
    kept: list[pa.RecordBatch] = []
    held, limit = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        if held < limit:
            continue
        whole = pa.Table.from_batches(kept).combine_chunks()
        keys = whole.column(key).to_numpy()
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield whole.slice(0, cut)
        kept = whole.slice(cut).to_batches()
        held = whole.num_rows - cut
        limit = max(rows, 2 * held)  # a long run is not put together again for every batch
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end positions of each run of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return starts, np.r_[starts[1:], len(keys)].astype(np.int64)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 3]: owners [0, 0, 1, 1, 1] and places within the owner [0, 1, 0, 1, 2]."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - np.repeat(first, counts)
