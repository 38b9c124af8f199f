"""Read routing over a stream of events, with the seen and cached marks as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from quern.functions import text as T
from quern.operators.routing import EVENT_SCHEMA, LARGE, REPEAT

#: A day: how long a path is remembered after its last read.
EXPIRY_MS = 86_400_000
DECISIONS = "seq long, file_path string, mtime_s long, decision string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(f"seq long, mtime_s long, newline_count int, {EVENT_SCHEMA}").json(folder)


def decide(n: int, targeted: bool, seen: bool, cached: bool, ok: bool = True, empty: bool = False) -> tuple[str, bool, bool]:
    """(decision, seen after, cached after); ok and empty tell what making the outline comes to, if it must be made."""
    if targeted:
        return "passthrough_targeted_ctx" if n >= LARGE and cached else "passthrough_targeted", seen, cached
    if n < REPEAT:
        return "passthrough_small", seen, cached
    if n < LARGE and not seen:
        return "passthrough_first_read", True, cached
    if not cached and not ok:
        return "passthrough_outline_failed", seen, False
    if not cached and empty:
        return "passthrough_empty_outline", seen, False
    return "outline_repeat" if n < LARGE else "outline_always", seen, True


def route_stream(events: DataFrame, expiry_ms: int = EXPIRY_MS) -> DataFrame:
    """Decisions in event order inside each micro-batch; state lives per path and modification second, until no read comes for expiry_ms.

    events(seq, file_path, offset, newline_count, mtime_s[, outline_ok, outline_empty]).
    """
    for c in ("outline_ok", "outline_empty"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(c == "outline_ok"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, cached = state.get if state.exists else (False, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, n, targeted, ok, empty in zip(*(rows[c] for c in ("seq", "newline_count", "targeted", "outline_ok", "outline_empty"))):
            decision, seen, cached = decide(int(n), bool(targeted), bool(seen), bool(cached), bool(ok), bool(empty))
            out.append((seq, key[0], key[1], decision))
        state.update((seen, cached))
        state.setTimeoutDuration(expiry_ms)
        yield pd.DataFrame(out, columns=["seq", "file_path", "mtime_s", "decision"])

    known = events.where("file_path <> '' AND newline_count IS NOT NULL").withColumn("targeted", T.is_numeric_offset(F.col("offset")))
    keyed = known.select("seq", "file_path", "mtime_s", "newline_count", "targeted", "outline_ok", "outline_empty").groupBy("file_path", "mtime_s")
    return keyed.applyInPandasWithState(step, DECISIONS, "seen boolean, cached boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)
