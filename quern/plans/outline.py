"""Whole-corpus plans: files to outlines with connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.operators.connections import file_connections, top_connections
from quern.operators.joined import tree_nodes, tree_tokens
from quern.operators.lines import line_counts
from quern.operators.render import render_outline
from quern.operators.tokens import token_occurrences
from quern.operators.tree import outline_nodes

RENDER_DEPTH = 2


def generate_outlines(files: DataFrame, max_depth: int | None = None, with_connections: bool = True) -> DataFrame:
    """files(file_id, content) to one outline each; links are those of the whole snapshot."""
    counts = line_counts(files).select("file_id", F.col("line_count").cast("int").alias("line_count"))
    links = top_connections(file_connections(token_occurrences(files, max_depth))) if with_connections else None
    return render_outline(counts, outline_nodes(files, max_depth), links, RENDER_DEPTH if max_depth is None else max_depth)


def outlines_of_trees(trees: DataFrame) -> DataFrame:
    """``generate_outlines`` of the rows of ``joined_trees``; the last top node of a file ends on its last line."""
    nodes = tree_nodes(trees)
    counts = nodes.groupBy("file_id").agg(F.max("end_line").alias("line_count"))
    return render_outline(counts, nodes, top_connections(file_connections(tree_tokens(trees))), RENDER_DEPTH)
