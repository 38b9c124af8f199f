"""The token index as tables: upsert, removal, eviction, persistence, and replay of a session."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from quern.functions import text as T
from quern.operators.connections import file_connections
from quern.operators.routing import CACHE_VERSION
from quern.operators.tokens import OCCURRENCES

CAPACITY = 256
MARKER = "at long, path string"
#: Markers that are tried, newest first.
KEPT = 8


def remove_files(occurrences: DataFrame, paths: DataFrame) -> DataFrame:
    """Without the files in paths(file_id); an unknown path changes nothing."""
    return occurrences.join(paths.select("file_id").distinct(), "file_id", "left_anti")


def upsert_files(occurrences: DataFrame, fresh: DataFrame, indexed: DataFrame) -> DataFrame:
    """indexed(file_id) lists every file indexed anew, those without a token included."""
    return remove_files(occurrences, indexed).unionByName(fresh)


def live_files(touches: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """touches(file_id, seq) to the files that survive eviction, newest last touch first.

    The capacity bounds the result; a global top-k keeps that many rows per task.
    """
    last = touches.groupBy("file_id").agg(F.max("seq").alias("last_touch"))
    return last.orderBy(F.desc("last_touch"), "file_id").limit(capacity)


def vocabulary_size(occurrences: DataFrame) -> DataFrame:
    return occurrences.agg(F.countDistinct("normalized").alias("size"))


def save_index(occurrences: DataFrame, folder: str) -> str:
    """Write to a new path and add a marker that names it, so a reader sees this index or the one before, never half of one."""
    path = f"{folder}/v-{uuid.uuid4().hex}"
    occurrences.write.parquet(path)
    spark = occurrences.sparkSession
    spark.createDataFrame([(time.time_ns(), path)], MARKER).coalesce(1).write.mode("append").json(f"{folder}/current")
    return path


def load_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index that was saved last and can be read; an empty one if there is none. Broken markers count as none."""
    try:
        paths = [r["path"] for r in spark.read.schema(MARKER).json(f"{folder}/current").where("path IS NOT NULL").orderBy(F.desc("at")).limit(KEPT).collect()]
    except AnalysisException:
        paths = []
    for path in paths:
        try:
            return spark.read.schema(OCCURRENCES).parquet(path)
        except AnalysisException:
            continue
    return spark.createDataFrame([], OCCURRENCES)


def purge_outlines(outlines: DataFrame, paths: DataFrame) -> DataFrame:
    """outlines(path_hash, ...) without entries or seen marks of the given paths(file_path)."""
    gone = paths.select(T.path_hash(F.col("file_path")).alias("path_hash")).distinct()
    return outlines.join(gone, "path_hash", "left_anti")


def missing_outlines(wanted: DataFrame, outlines: DataFrame) -> DataFrame:
    """Files whose outline isn't cached: anti join on path hash, modification second and version."""
    keys = ["path_hash", "mtime_s", "version"]
    keyed = wanted.withColumns({"path_hash": T.path_hash(F.col("file_path")), "mtime_s": T.mtime_seconds(F.col("mtime")), "version": F.lit(CACHE_VERSION)})
    return keyed.join(outlines.select(keys).distinct(), keys, "left_anti")


def invalidate(edits: DataFrame, outlines: DataFrame, occurrences: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an edit leaves behind: outlines and index without the edited files, and the edits with their response and logged decision.

    edits(file_path, exists): an empty or null path, and a file that isn't there, change nothing and log nothing.
    """
    done = F.coalesce((F.col("file_path") != "") & F.col("exists"), F.lit(False))
    paths = edits.where(done).select("file_path").distinct()
    answered = edits.withColumns({"response": F.lit("{}"), "decision": F.when(done, "invalidated")})
    return purge_outlines(outlines, paths), remove_files(occurrences, paths.withColumnRenamed("file_path", "file_id")), answered


def replay_connections(occurrences: DataFrame, order: list[str], capacity: int = CAPACITY) -> dict[str, DataFrame]:
    """Links of each file as a session sees them: file k knows only the live files before it.

    For a short, stated list of files; the snapshot form covers whole corpora.
    """
    live: list[str] = []
    out = {}
    for path in order:
        live = [p for p in live if p != path][-(capacity - 1) :] if capacity > 1 else []
        live.append(path)
        seen = occurrences.where(F.col("file_id").isin(live))
        out[path] = file_connections(seen, occurrences.sparkSession.createDataFrame([(path,)], "file_id string"))
    return out


def recency(touches: DataFrame) -> DataFrame:
    """Every file with its place in last-touch order, 1 being the newest."""
    last = touches.groupBy("file_id").agg(F.max("seq").alias("last_touch"))
    return last.withColumn("age", F.row_number().over(W.orderBy(F.desc("last_touch"), "file_id")))
