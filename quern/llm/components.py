"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.llm.common import written

#: Graphs of up to so many edges, 4 MB, are joined in one task.
ONE_TASK = 250_000


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of longs to (node, root), root being the smallest node; nodes without an edge are left out.

    Each round is a few joins and partial aggregates on the edges, written to
    the shared folder; rounds grow with the logarithm of the diameter. Only a
    count and a checksum come to the driver.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = written(e, "edges"), None
    while True:
        # The sum wraps around unsigned halves, so it can't overflow a long.
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(F.xxhash64("u", "v"), 32))).first())
        if now == before or not now[0]:
            break
        before = now
        e = written(_stars(e), "stars")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (u, v) and the smallest node of each one's component."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(ids))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def joined(edges: DataFrame) -> DataFrame:
    """What ``components`` gives of written edges, in one task while they are few: its rounds are dozens of stages, however small the graph."""
    if edges.count() > ONE_TASK:
        return components(edges)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = list(batches)
        if kept:
            u, v = (np.concatenate([b.column(c).to_numpy() for b in kept]) for c in ("u", "v"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_nodes(u, v)], ["node", "root"])

    return written(edges.where("u <> v").select("u", "v").coalesce(1).mapInArrow(run, "node long, root long"), "roots")
