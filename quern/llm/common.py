"""Shared pieces: reading tables, written intermediate tables, sorted groups in Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch; bounds what a Python worker holds of long texts.
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where it is unset and all runs on this machine, as in tests, a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        kept = tempfile.TemporaryDirectory(prefix="quern-")
        atexit.register(kept.cleanup)
        found = f"file://{kept.name}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside are removed as each of them ends; the session's own setting comes back after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which cuts the lineage; partitioned by a column if one is named."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> Column:
    """All columns as one, so that no column that is added to a row clashes with one it has."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def crc_mod(column: str, n: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, nulls as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.large_binary() if pa.types.is_large_string(batch.column(name).type) else pa.binary()).to_pylist()]


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by keys: a table and the offsets at which its groups start, with the end."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        new = np.zeros(t.num_rows - 1, dtype=bool)
        for k in keys:
            v = t.column(k).to_numpy()
            new |= v[1:] != v[:-1]
        starts = np.flatnonzero(new) + 1
        if len(starts):
            yield t.slice(0, starts[-1]), np.concatenate([[0], starts])
            t = t.slice(starts[-1])
        rest = t
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each node of a symmetric boolean matrix."""
    n = len(linked)
    root = np.arange(n)
    while True:
        least = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def in_blocks(rows: DataFrame, keys: list[str], spread: Column, size: int) -> DataFrame:
    """Rows of keys that hold two or more, dealt to pairs of blocks.

    A key of n rows has ceil(n / size) blocks; ``blk`` is the row's own, and the
    row goes to every pair (bi, bj) that has it. So a task never holds more than
    two blocks of a key, however large the key is, and every two rows of a key
    meet in some pair.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    x = rows.join(counts, keys).withColumn("_b", F.ceil(F.col("_n") / size).cast("int"))
    x = x.withColumn("blk", F.pmod(spread, F.col("_b")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    x = x.withColumn("_o", other)
    return x.withColumns({"bi": F.least("blk", "_o"), "bj": F.greatest("blk", "_o")}).drop("_n", "_b", "_o")
