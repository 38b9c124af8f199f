"""Line deduplication by a join of deletion neighbourhoods, edit bound one.

Lines within one edit of each other share a variant: the line itself or the line
with one character left out, at the same place if a character was replaced.
One edit leaves the first or the last half of the shorter line whole, and all but one
of any segments; so only lines that share a half, and then all segments but one, with
another distinct line need variants at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from quern.llm.common import packed, small_batches, table, texts, written

MAX_EDITS = 1
#: Parts of a line of which a partner has all but one; in shorter lines some are empty.
SEGMENTS = 16
#: Variants of one Arrow batch, plus those of one line.
VARIANT_ROWS = 100_000


def normal(line: bytes) -> bytes:
    """Without white space at the ends, A-Z in lower case."""
    return line.strip().lower()


def _key(*parts: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"\n".join(parts), seed)


def _chars(line: bytes) -> bytes | str:
    """The line as a sequence of code points: ASCII bytes serve as they are."""
    return line if line.isascii() else line.decode("utf-8", "replace")


def _raw(part: bytes | str) -> bytes:
    return part if isinstance(part, bytes) else part.encode()


def segment_keys(line: bytes, segments: int) -> list[int]:
    """Keys of the line less one of its segments, for a partner as long, or one character shorter or longer.

    The segments are those of the shorter line; what stands before is counted from the left,
    what stands after from the right. An edit falls into some segment, so the rest is equal.
    """
    c = _chars(line)
    n = len(c)
    keys = []
    for short in (n, n - 1):
        for k in range(segments):
            start, end = k * short // segments, (k + 1) * short // segments
            keys.append(_key(_raw(c[:start]), _raw(c[n - short + end :]), seed=short * segments + k))
    return keys


def _signed(x: list[int]) -> pa.Array:
    return pa.array(np.array(x, dtype=np.uint64).view(np.int64))


def filled_lines(docs: DataFrame, text: bool) -> DataFrame:
    """(doc_id, line_no, h) of lines that aren't blank, with norm or with halves; documents without an id or text have none."""
    last = "norm" if text else "halves"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, number, h, more = [], [], [], []
            for r, t in enumerate(texts(batch)):
                for k, line in enumerate(t.split(b"\n")):
                    x = normal(line)
                    if not x:
                        continue
                    rows.append(r)
                    number.append(k)
                    h.append(_key(x, seed=0))
                    if text:
                        more.append(x)
                    else:
                        more.extend(segment_keys(x, 2))
            if rows:
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 4), _signed(more)) if not text else pa.array(more, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows)), pa.array(number, pa.int32()), _signed(h), lists], ["doc_id", "line_no", "h", last])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return found.mapInArrow(run, f"doc_id {kind}, line_no int, h long, {last} {'string' if text else 'array<long>'}")


def with_partner(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``lines`` of which some key of keys(h, key) is that of another h too."""
    shared = keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    return lines.join(keys.join(shared, "key", "left_semi").select("h").distinct(), "h", "left_semi")


def fine_keys(lines: DataFrame) -> DataFrame:
    """(h, norm) to (h, key), a key for each of SEGMENTS left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = [segment_keys(line, SEGMENTS) for line in texts(batch, "norm")]
                at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([batch.column("h").take(at), _signed([x for k in keys for x in k])], ["h", "key"])

    return lines.select("h", "norm").mapInArrow(run, "h long, key long")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variant_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of the line, and of the line without each of its characters; equal texts have equal hashes."""
    c = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))[:n]
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mixed(c + np.uint64(1)) * power)])
        less = prefix[:-1] + (prefix[-1] - prefix[1:]) * _INVERSE
        return int(_mixed(prefix[-1:]).view(np.int64)[0]), _mixed(less).view(np.int64)


def variants(lines: DataFrame) -> DataFrame:
    """(h, doc_id, line_no, norm) to (key, place, h, doc_id, line_no).

    place -1: the whole line; -2: the line less a character, to meet whole lines;
    from 0 on: the line less that character, to meet lines with another there.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch, at, keys, place):
            at = pa.array(np.repeat(at, [len(k) for k in keys]))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(place).astype(np.int32)), *(batch.column(c).take(at) for c in ("h", "doc_id", "line_no"))], ["key", "place", "h", "doc_id", "line_no"])

        for batch in batches:
            at, keys, place, size = [], [], [], 0
            for k, line in enumerate(batch.column("norm").to_pylist()):
                whole, less = variant_hashes(line)
                at.append(k)
                keys.append(np.concatenate([[whole], less, less]))
                place.append(np.concatenate([[-1], np.full(len(less), -2), np.arange(len(less))]))
                size += len(keys[-1])
                if size >= VARIANT_ROWS:
                    yield rows(batch, at, keys, place)
                    at, keys, place, size = [], [], [], 0
            if at:
                yield rows(batch, at, keys, place)

    kind = lines.schema["doc_id"].dataType.simpleString()
    return lines.select("h", "doc_id", "line_no", "norm").mapInArrow(run, f"key long, place int, h long, doc_id {kind}, line_no int")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, dropped) for documents that lose lines; line numbers from 0.

    A line is dropped if an equal line, or one within the edit bound, stands
    earlier by (doc_id, line_no). Rows that repeat a doc_id stand at the same place.
    """
    small_batches(docs.sparkSession)
    at = written(filled_lines(docs, text=False), "lines")
    first = at.groupBy("h").agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    halves = at.select("h", F.explode("halves").alias("key"))
    near = with_partner(first, halves)
    place = near.select("h", F.col("first.doc_id").alias("doc_id"), F.col("first.line_no").alias("line_no"))
    # One text per distinct line: that of its first place; repeated rows have the same one.
    candidates = filled_lines(docs, text=True).join(place, ["h", "doc_id", "line_no"], "left_semi").dropDuplicates(["h"])
    candidates = written(candidates, "candidates")
    candidates = written(with_partner(candidates, fine_keys(candidates)), "near")
    v = written(variants(candidates), "variants")
    seat = F.struct("doc_id", "line_no", "h")
    swap = v.where("place >= 0")
    earliest = swap.groupBy("key", "place").agg(F.min(seat).alias("e"), F.count("*").alias("n")).where("n > 1")
    pairs = swap.join(earliest, ["key", "place"]).where("h <> e.h").select("h", F.col("e.h").alias("o"))
    cut = v.where("place = -2").groupBy("key").agg(F.min(seat).alias("e"))
    whole = v.where("place = -1")
    # Of a line that lost a character and a whole line, either may be the earlier one.
    pairs = pairs.unionByName(whole.join(cut, "key").select("h", F.col("e.h").alias("o")))
    mine = v.where("place = -2").select("key", "h")
    pairs = pairs.unionByName(mine.join(whole.select("key", F.col("h").alias("o")), "key").select("h", "o")).distinct()
    a, b = (candidates.select(F.col("h").alias(k), F.struct("doc_id", "line_no").alias(f"at_{k}"), F.col("norm").alias(f"t_{k}")) for k in ("h", "o"))
    close = pairs.join(a, "h").join(b, "o").where("at_o < at_h").where(F.levenshtein("t_h", "t_o", MAX_EDITS) >= 0).select("h").distinct()
    fate = written(first.join(close.withColumn("near", F.lit(True)), "h", "left"), "fate")
    gone = at.select("doc_id", "line_no", "h").join(fate, "h").where(F.col("near") | (F.struct("doc_id", "line_no") != F.col("first")))
    return gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def without(text: Column, dropped: Column) -> Column:
    parts = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), dropped)
    return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs without dropped lines; n_chars follows the text. A document that loses its last filled line goes.

    Null texts, and documents without an id, stay as they are, and so do columns of any other name.
    """
    gone = dropped_lines(docs).select(F.col("doc_id").alias("id"), "dropped")
    x = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("doc"), F.col("text").alias("old"))
    x = x.join(gone, x["doc"] == gone["id"], "left")
    whole = F.col("dropped").isNull()
    x = x.withColumn("new", F.when(whole, F.col("old")).otherwise(without(F.col("old"), F.col("dropped"))))
    x = x.where(whole | (F.length(F.regexp_replace("new", r"\s+", "")) > 0))
    own = lambda c: F.col("row").getField(c)
    changed = {"text": F.col("new"), "n_chars": F.when(whole, own("n_chars")).otherwise(F.length("new").cast("long"))}
    return x.select(*((changed[c] if c in changed else own(c)).alias(c) for c in docs.columns))


def op9_lines(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    none = F.array().cast("array<int>")
    x = docs.select("doc_id", n.alias("n_lines")).join(dropped_lines(docs), "doc_id", "left")
    return x.select("doc_id", "n_lines", F.coalesce(F.size(F.coalesce("dropped", none)), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))
