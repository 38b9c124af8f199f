"""Sources and sinks: whole files, driver tables as files, cached outlines and logs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """files(file_id, mtime, content) from a folder; bytes are decoded as UTF-8, broken ones become U+FFFD, and line ends stay as they are.

    Files without a byte are not listed, as the reader leaves them out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        F.regexp_replace("path", "^file:/*", "/").alias("file_id"), (F.unix_micros("modificationTime") / 1000).alias("mtime"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    )


def documents_as_files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.col("text").alias("content"))


def sources_as_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per source: its texts in doc_id order, a blank line between. Each is one row, so no query of a large table may use it."""
    docs = table(spark, folder, "documents").groupBy(F.col("source").alias("file_id"))
    joined = docs.agg(F.array_sort(F.collect_list(F.struct(F.col("doc_id").isNull(), "doc_id", "text"))).alias("t"))
    return joined.select("file_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("content"))


def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that ``sources_as_files`` joins, one a row: (file_id, doc_id, text)."""
    return table(spark, folder, "documents").select(F.col("source").alias("file_id"), "doc_id", "text")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once and read again: from the checkpoint folder, or from a temporary one where all runs on this machine."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        kept = tempfile.TemporaryDirectory(prefix="quern-")
        atexit.register(kept.cleanup)
        folder = f"file://{kept.name}"
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pages_as_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per page, a line break between adjoining tags."""
    page = table(spark, folder, "pages")
    return page.select(F.col("page_id").cast("string").alias("file_id"), F.replace("html", F.lit("><"), F.lit(">\n<")).alias("content"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def write_outlines(outlines: DataFrame, path: str) -> None:
    """outlines(path_hash, mtime_s, version, outline), appended."""
    outlines.write.mode("append").parquet(path)
