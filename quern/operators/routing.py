"""Read routing over events: when an outline is served instead of the file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from quern.functions import text as T

# Fixed values of the routing table.
LARGE = 300
REPEAT = 100
CACHE_VERSION = 2
EDIT_HINT = "You can Edit this section using content from this Read. Prefer incremental edits over sweeping rewrites, but use your judgement based on the task."
READ_HINT = "Read with offset/limit to get actual code for any section — use the line ranges to target your read. For larger spans, paginate with increasing offsets. Prefer incremental edits over sweeping rewrites, but use your judgement based on the task."
EVENT_SCHEMA = "hook_event_name string, source string, file_path string, offset string, limit string, tool_input struct<file_path:string,offset:string,limit:string>, input struct<file_path:string,offset:string,limit:string>"


def parse_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON payloads, nested or flat, to file_path, offset and limit; bad JSON gives nulls."""
    e = F.from_json(column, EVENT_SCHEMA)
    x = raw.withColumn("e", e)
    pick = lambda f: F.when(F.col("e.tool_input").isNotNull(), F.col(f"e.tool_input.{f}")).otherwise(F.col(f"e.{f}"))
    return x.withColumns({f: pick(f) for f in ("file_path", "offset", "limit")} | {"hook_event_name": F.col("e.hook_event_name"), "source": F.col("e.source")}).drop("e")


def cache_key(path: str = "file_path", mtime_s: str = "mtime_s"):
    return F.concat(T.path_hash(F.col(path)), F.lit("-"), F.col(mtime_s), F.lit(f"-v{CACHE_VERSION}"))


def route_reads(events: DataFrame) -> DataFrame:
    """events(seq, file_path, offset, newline_count, mtime_s[, outline_ok, outline_empty]) to one decision each.

    A decision depends on earlier untargeted reads of the same path and
    modification time, which are windows over ``seq``.
    """
    for c in ("outline_ok", "outline_empty"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(c == "outline_ok"))
    n, path = F.col("newline_count"), F.col("file_path")
    known = F.coalesce(path != "", F.lit(False)) & n.isNotNull()
    earlier = W.partitionBy("file_path", "mtime_s").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    x = events.withColumn("targeted", known & T.is_numeric_offset(F.col("offset")))
    x = x.withColumn("marks", known & ~F.col("targeted") & (n >= REPEAT) & (n < LARGE))
    x = x.withColumn("seen", F.coalesce(F.bool_or("marks").over(earlier), F.lit(False)))
    made = known & ~F.col("targeted") & ((n >= LARGE) | (F.col("marks") & F.col("seen"))) & F.col("outline_ok") & ~F.col("outline_empty")
    x = x.withColumn("makes", made)
    x = x.withColumn("cached", F.coalesce(F.bool_or("makes").over(earlier), F.lit(False)))
    decision = (
        F.when(~known, F.lit(None).cast("string"))
        .when(F.col("targeted") & (n >= LARGE) & F.col("cached"), "passthrough_targeted_ctx")
        .when(F.col("targeted"), "passthrough_targeted")
        .when(n < REPEAT, "passthrough_small")
        .when((n < LARGE) & ~F.col("seen"), "passthrough_first_read")
        .when(~F.col("cached") & ~F.col("outline_ok"), "passthrough_outline_failed")
        .when(~F.col("cached") & F.col("outline_empty"), "passthrough_empty_outline")
        .when(n < LARGE, "outline_repeat")
        .otherwise("outline_always")
    )
    return x.withColumn("decision", decision).drop("marks", "makes", "targeted")


def responses(routed: DataFrame) -> DataFrame:
    """The JSON answer to each routed read."""
    repeat = F.col("decision") == "outline_repeat"
    context = F.concat(
        F.when(repeat, "Previously read in full. Outline of ").otherwise("Structural outline of "), T.basename(F.col("file_path")),
        F.format_string(" (%d lines). ", "newline_count"), F.when(repeat, "for reference. ").otherwise(""), F.lit(READ_HINT),
    )
    body = lambda *extra: F.to_json(F.struct(F.struct(F.lit("PreToolUse").alias("hookEventName"), F.lit("allow").alias("permissionDecision"), *extra).alias("hookSpecificOutput")))
    served = body(F.struct(F.concat(cache_key(), F.lit(".txt")).alias("file_path")).alias("updatedInput"), context.alias("additionalContext"))
    answer = F.when(F.col("decision") == "passthrough_targeted_ctx", body(F.lit(EDIT_HINT).alias("additionalContext"))).when(F.col("decision").startswith("outline_"), served).otherwise("{}")
    return routed.withColumn("response", answer)


def handlers(events: DataFrame) -> DataFrame:
    """Which handler takes an event(hook_event_name, tool_name)."""
    name, tool = F.col("hook_event_name"), F.col("tool_name")
    handler = (
        F.when(name.isin("SessionStart", "SubagentStart"), "session_start")
        .when((name == "PreToolUse") & (tool == "Read"), "pre_read")
        .when((name == "PostToolUse") & tool.isin("Edit", "Write"), "post_edit")
    )
    return events.withColumn("handler", handler)


def session_context(events: DataFrame, context: str) -> DataFrame:
    """The session-start answer: the event's name back, with a constant context."""
    name = F.when(F.length("hook_event_name") > 0, F.col("hook_event_name")).otherwise("SessionStart")
    body = F.to_json(F.struct(F.struct(name.alias("hookEventName"), F.lit(context).alias("additionalContext")).alias("hookSpecificOutput")))
    return events.withColumns({"response": body, "logged_source": F.when(F.length("source") > 0, F.col("source")).otherwise("unknown")})


def repeat_reads(events: DataFrame) -> DataFrame:
    w = W.partitionBy("file_path", "mtime_s").orderBy("seq")
    return events.withColumn("is_repeat", F.row_number().over(w) > 1)


def hook_log(routed: DataFrame) -> DataFrame:
    """Log rows of routed reads; reads without a decision leave none."""
    return routed.where("decision IS NOT NULL").select(
        F.lit("pre-read").alias("hook"), "decision", F.col("file_path").alias("file"), F.col("newline_count").alias("lines"),
        F.when(F.col("decision") == "passthrough_targeted_ctx", F.col("offset").cast("long")).alias("offset"),
        F.when(F.col("decision").startswith("outline_"), F.col("cached")).when(F.col("decision").endswith("outline_failed") | F.col("decision").endswith("empty_outline"), False).alias("cache_hit"),
    )
