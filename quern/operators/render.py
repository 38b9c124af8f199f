"""Outline text from node rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.functions import text as T


def node_lines(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(file_id, node_id, text) for each node that shows at this depth."""
    kids = nodes.where("parent_id IS NOT NULL").groupBy("file_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    x = nodes.join(kids, ["file_id", "node_id"], "left").fillna({"kids": 0})
    indent = F.repeat(F.lit("  "), F.col("tree_depth"))
    span = F.format_string("[%d-%d] ", "start_line", "end_line")
    sample = F.when(F.length("sample_line") > 0, F.concat(F.lit("\n"), indent, F.lit("  sample: "), F.col("sample_line"))).otherwise("")
    shown = F.when(F.col("collapsed"), F.concat(indent, span, F.coalesce("pattern", "label"), sample)).otherwise(
        F.concat(indent, span, F.col("label_line"), F.lit(":"), F.col("label"))
    )
    if max_depth is not None:
        folded = F.concat(indent, span, F.format_string("... (%d children)", "kids"))
        x = x.where(F.col("tree_depth") <= max(max_depth, 1))
        shown = F.when((F.col("tree_depth") >= max_depth) & (F.col("kids") > 0), folded).otherwise(shown)
    return x.select("file_id", "node_id", shown.alias("text"))


def render_outline(files: DataFrame, nodes: DataFrame, connections: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """One outline per row of files(file_id, line_count); connections come ranked from ``top_connections``."""
    rows = node_lines(nodes, max_depth).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "text"))).alias("rows"))
    x = files.join(rows, "file_id", "left")
    link = F.lit("")
    if connections is not None:
        one = F.struct("rank", F.concat(T.direction_arrow(F.col("direction")), F.lit(" "), T.basename(F.col("target_file"))).alias("text"))
        tops = connections.where("rank <= 5").groupBy(F.col("source_file").alias("file_id")).agg(F.array_sort(F.collect_list(one)).alias("links"))
        x = x.join(tops, "file_id", "left")
        link = F.when(F.size("links") > 0, F.concat(F.lit("\n  connections: "), F.array_join(F.transform("links", lambda r: r["text"]), ", "))).otherwise("")
    head = F.concat(T.basename(F.col("file_id")), F.format_string(" [%d lines]", "line_count"), link, F.lit("\n  ---"))
    body = F.transform(F.coalesce("rows", F.array().cast("array<struct<node_id:int,text:string>>")), lambda r: r["text"])
    return x.select("file_id", F.array_join(F.concat(F.array(head), body), "\n").alias("outline"))
