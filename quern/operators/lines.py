"""Line tables: splitting, per-line signals, order-sensitive windows and per-file aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from quern.functions import text as T


def split_lines(files: DataFrame) -> DataFrame:
    """files(file_id, content) to lines(file_id, line_no, line); a final newline leaves a last empty line."""
    parts = F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n", -1)).alias("pos", "line")
    return files.select("file_id", parts).select("file_id", (F.col("pos") + 1).alias("line_no"), "line")


def line_counts(files: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    newlines = T.newline_count(content)
    return files.select("file_id", newlines.alias("newline_count"), (newlines + 1).alias("line_count"))


def line_signals(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return lines.withColumns(
        {
            "entropy": T.shannon_entropy(line),
            "indent": T.indent_depth(line),
            "bracket_delta": T.bracket_delta(line),
            "tag_delta": T.tag_delta(line),
            "is_blank": T.is_blank(line),
        }
    )


def by_file() -> W:
    return W.partitionBy("file_id").orderBy("line_no")


def running_depth(signals: DataFrame) -> DataFrame:
    w = by_file().rowsBetween(W.unboundedPreceding, 0)
    return signals.withColumns({"bracket_depth": F.sum("bracket_delta").over(w), "tag_depth": F.sum("tag_delta").over(w)})


def smoothed_entropy(signals: DataFrame, window: int) -> DataFrame:
    """Centred mean over window // 2 lines on each side, cut off at the file's ends."""
    half = window // 2
    return signals.withColumn("smoothed", F.avg("entropy").over(by_file().rowsBetween(-half, half)))


def entropy_gradient(smoothed: DataFrame) -> DataFrame:
    step = F.abs(F.col("smoothed") - F.lag("smoothed").over(by_file()))
    return smoothed.withColumn("gradient", F.coalesce(step, F.lit(0.0)))


def upper_tenth(values: Column) -> Column:
    """The element at floor(0.9 n) of the sorted group."""
    ordered = F.array_sort(F.collect_list(values))
    return F.element_at(ordered, F.floor(F.size(ordered) * 0.9).cast("int") + 1)


def gradient_p90(gradients: DataFrame) -> DataFrame:
    return gradients.groupBy("file_id").agg(upper_tenth(F.col("gradient")).alias("p90"))


def entropy_stats(signals: DataFrame) -> DataFrame:
    """Population mean, deviation and their ratio over lines that are not blank."""
    filled = F.when(~F.col("is_blank"), F.col("entropy"))
    stats = signals.groupBy("file_id").agg(
        F.coalesce(F.avg(filled), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(filled), F.lit(0.0)).alias("std"), F.avg("entropy").alias("region_mean")
    )
    return stats.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0))


def adjacent_similarity(lines: DataFrame) -> DataFrame:
    """Mean trigram similarity of neighbouring lines; 1 for a single line."""
    grams = lines.select("file_id", "line_no", T.trigrams(F.col("line")).alias("grams"))
    after = grams.withColumn("after", F.lead("grams").over(by_file()))
    return after.groupBy("file_id").agg(
        F.coalesce(F.avg(F.when(F.col("after").isNotNull(), T.jaccard(F.col("grams"), F.col("after")))), F.lit(1.0)).alias("similarity")
    )


def label_lines(lines: DataFrame) -> DataFrame:
    """Each file's label: the first line that is neither blank nor a comment, else the first filled one."""
    line = F.col("line")
    filled = lines.where(~T.is_blank(line)).select("file_id", "line_no", T.label_text(line).alias("label"), T.is_comment(line).alias("comment"))
    first = filled.groupBy("file_id").agg(F.min_by(F.struct("label", "line_no"), F.struct("comment", "line_no")).alias("top"))
    files = lines.select("file_id").distinct()
    return files.join(first, "file_id", "left").select(
        "file_id", F.coalesce("top.label", F.lit("(empty)")).alias("label"), F.coalesce("top.line_no", F.lit(1)).alias("label_line")
    )


def boundary_candidates(signals: DataFrame) -> DataFrame:
    """Cuts that single lines of a whole file suggest, with scores, before any thinning."""
    steps = entropy_gradient(smoothed_entropy(running_depth(signals), 15))
    o = by_file()
    # The element at floor(0.9 n) of the file's sorted gradients, by a rank among them.
    sized = steps.withColumns({"n": F.count("*").over(W.partitionBy("file_id")), "place": F.row_number().over(W.partitionBy("file_id").orderBy("gradient"))})
    sized = sized.withColumn("gradient", F.when(F.col("n") >= 31, F.col("gradient")).otherwise(0.0))
    tenth = F.max(F.when(F.col("place") == F.floor(F.col("n") * 0.9) + 1, F.col("gradient"))).over(W.partitionBy("file_id"))
    x = sized.withColumns(
        {
            "scale": F.when(tenth > 0.01, tenth).otherwise(T.GRADIENT_SCALE),
            "before": F.lag("bracket_depth").over(o),
            "tag_before": F.lag("tag_depth").over(o),
            "indent_before": F.lag("indent").over(o),
            "next_gradient": F.lead("gradient").over(o),
        }
    )
    line, e, i = F.col("line"), T.entropy_factor(F.col("gradient"), F.col("scale")), F.col("line_no") - 1
    last = F.col("line_no") == F.col("n")
    drop = F.col("indent_before") - F.col("indent")
    cut = lambda rule, at, score: F.struct(F.lit(rule).alias("rule"), at.alias("at"), score.alias("score"))
    level = T.heading_level(line)
    found = (
        F.when(T.is_separator(line), cut("separator", i, F.lit(5.0)))
        .when(level > 0, cut("heading", i, T.heading_ceiling(level) * (0.4 + 0.6 * e)))
        .when(F.col("is_blank"), cut("blank", i, 3 * e))
        .when(
            (F.col("bracket_depth") <= 0) & (F.col("before") > 0) & ~last,
            cut("bracket", i + 1, 2 * (0.5 + 0.5 * T.entropy_factor(F.col("next_gradient"), F.lit(T.GRADIENT_SCALE)))),
        )
        .when((F.col("tag_delta") < 0) & (F.col("tag_depth") < F.col("tag_before")), F.when(~last, cut("tag", i + 1, 2 * e)))
        .when((drop > 0) & ((F.col("indent") == 0) | (drop >= 8)), cut("dedent", i, e))
    )
    return x.select("file_id", found.alias("c")).where("c IS NOT NULL").select("file_id", "c.rule", "c.at", "c.score")
