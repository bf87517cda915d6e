"""What the operators of this subpackage share: tables, shared storage, grouped Arrow streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; one of our own only where that is unset and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rillstone-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage, and those of all steps add up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_written: list[str] = []


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it again: lineage ends there, and a lost executor costs nothing. sweep() removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with released(spark):
        df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Removes the tables that cut() wrote in this program; for when all results that read them are stored."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def buckets(df: DataFrame, each_mb: int = 32, most: int = 1 << 20) -> int:
    """How many parts a shuffle of df's size needs so that one fits a task: by the plan's size, at least shuffle.partitions.

    Spark says exabytes where it doesn't know; from a petabyte on, the sizes of the tables that the plan reads count instead.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if size >= 1 << 50:
        leaves = plan.collectLeaves()
        size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, -(-size // (each_mb << 20))))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 8 << 20, most_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text, a longer text by itself: batches are cut by rows, but memory follows bytes."""
    lengths = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths, dtype=np.int64) // most_bytes + np.arange(batch.num_rows) // most_rows
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def runs(batches: Iterator[pa.RecordBatch], same: list[str], most_bytes: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole groups from batches that are sorted by the columns ``same``; a table ends only where a group does."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most_bytes:
            continue
        whole = pa.Table.from_batches(held)
        last = [whole.column(c)[whole.num_rows - 1] for c in same]
        at = whole.num_rows
        step = 1
        low = 0
        while at - step > 0:  # gallop back to a row of another group
            if [whole.column(c)[at - step] for c in same] != last:
                low = at - step + 1
                break
            step *= 2
        high = at - step // 2 if step > 1 else at
        first = low
        while low and first < high:
            mid = (first + high) // 2
            if [whole.column(c)[mid] for c in same] == last:
                high = mid
            else:
                first = mid + 1
        if not first and [whole.column(c)[0] for c in same] == last:
            continue  # one group so far
        yield whole.slice(0, first)
        rest = whole.slice(first).combine_chunks()
        held, size = rest.to_batches(), rest.nbytes
    if held:
        yield pa.Table.from_batches(held)


Query = Callable[[SparkSession, str], DataFrame]
