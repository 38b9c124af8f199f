"""Token statistics and directed links between files, scored by inverse document frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from quern.functions import text as T


def token_stats(occurrences: DataFrame) -> DataFrame:
    files = occurrences.select("file_id").distinct().agg(F.count("*").alias("total"))
    per_file = occurrences.groupBy("normalized", "file_id").agg(
        F.count_if(F.col("position") == "header").alias("h"), F.count_if(F.col("position") == "body").alias("b")
    )
    stats = per_file.groupBy("normalized").agg(F.count("*").alias("file_count"), F.sum("h").alias("header_count"), F.sum("b").alias("body_count"))
    # One row, so its broadcast is bounded.
    return stats.join(F.broadcast(files)).withColumn("idf", T.idf(F.col("total"), F.col("file_count")))


def get_token_stats(occurrences: DataFrame, token: str) -> DataFrame:
    return token_stats(occurrences).where(F.col("normalized") == token.lower())


def file_tokens(occurrences: DataFrame) -> DataFrame:
    """One row per file and token: where it occurs and the first ordinal."""
    return occurrences.groupBy("file_id", "normalized").agg(
        F.bool_or(F.col("position") == "header").alias("in_header"), F.bool_or(F.col("position") == "body").alias("in_body"), F.min("ord").alias("ord")
    )


def _link(header: str, body: str, other_header: str, other_body: str) -> tuple:
    h, b, oh, ob = map(F.col, (header, body, other_header, other_body))
    out, into, both = h & ob & ~oh, oh & b & ~h, h & oh
    kind = F.when(out | into, "api_dependency").when(both, "shared_interface").otherwise("conceptual_coupling")
    return kind, F.when(out, "outgoing").when(into, "incoming").otherwise("bidirectional")


def file_connections(occurrences: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Every link of every file, or of the files in ``sources(file_id)``.

    Tokens pair files only inside the document-frequency band of 2 to max(N/2, 2)
    files, so no token of most files is ever joined with itself. Rows without a
    file link with nothing and count as no file.
    """
    # Both are named, so that all uses below have one plan and share its exchange.
    occurrences = occurrences.where("file_id IS NOT NULL AND normalized IS NOT NULL")
    stats = token_stats(occurrences).where((F.col("total") >= 2) & (F.col("file_count") >= 2) & (F.col("file_count") <= F.greatest(F.col("total") / 2, F.lit(2))))
    banded = file_tokens(occurrences).join(stats.select("normalized", "idf"), "normalized")
    left = banded if sources is None else banded.join(sources.select("file_id").distinct(), "file_id", "left_semi")
    right = banded.select("normalized", *(F.col(c).alias(f"o_{c}") for c in ("file_id", "in_header", "in_body")))
    kind, direction = _link("in_header", "in_body", "o_in_header", "o_in_body")
    pairs = left.join(right, "normalized").where("file_id <> o_file_id").select(
        F.col("file_id").alias("source_file"), F.col("o_file_id").alias("target_file"), kind.alias("type"), direction.alias("direction"), "normalized", "idf", "ord"
    )
    edges = pairs.groupBy("source_file", "target_file", "type", "direction").agg(
        F.sum("idf").alias("strength"), F.array_sort(F.collect_list(F.struct("ord", "normalized"))).alias("t"), F.min("ord").alias("first_ord")
    )
    return edges.withColumn("shared_tokens", F.transform("t", lambda x: x["normalized"])).drop("t")


def top_connections(edges: DataFrame, limit: int = 5) -> DataFrame:
    """The strongest links of each file; limit 0 keeps all.

    Ties go by the first shared token of the source, then by target, type and
    direction, so the order is total.
    """
    order = [F.round("strength", 9).desc(), "first_ord", "target_file", "type", "direction"]
    ranked = edges.withColumn("rank", F.row_number().over(W.partitionBy("source_file").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit) if limit else ranked
