"""Repeated passages by a sparse set of suffixes at content-selected minimiser positions.

A word position is kept if the hash of the KEY words from it is the least in some
window of MIN_WORDS - KEY + 1 neighbouring positions; so every passage of
MIN_WORDS words holds a kept position, at the same place in each of its copies.
Kept suffixes whose first KEY words another document has too are extended to the left
and right, to every passage of MIN_WORDS words that was kept for them. Those are sorted by a
fingerprint of 128 bits, neighbours are compared, and overlapping repeated passages merge
into spans. Passages that are so common that they would fill a task are told apart by an aggregate instead.

A suffix array would order suffixes by their words and take a neighbour's common prefix for the longest match;
with sparse suffixes the partner that agrees to the left need not be a neighbour, so
the extended passages are sorted, not the suffixes. Words are compared by fingerprints alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.llm.common import groups, packed, small_batches, table, texts, written
from quern.llm.decontaminate import merged

MIN_WORDS = 50
KEY = 25
#: A passage that more rows have than this, and than this part of all, is common.
COMMON_ROWS, COMMON_PART = 10_000, 50_000
_B = 0x9E3779B97F4A7C15
_M = 1 << 64


class _Powers:
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            with np.errstate(over="ignore"):
                one = np.ones(1, dtype=np.uint64)
                cls.up = np.cumprod(np.concatenate([one, np.full(n - 1, _B, dtype=np.uint64)]))
                cls.down = np.cumprod(np.concatenate([one, np.full(n - 1, pow(_B, -1, _M), dtype=np.uint64)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    w = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; equal runs have equal hashes wherever they stand."""
    _Powers.reach(len(h) + 1)
    with np.errstate(over="ignore"):
        p = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * _Powers.up[: len(h)])])
        return _mixed((p[size:] - p[:-size]) * _Powers.down[: len(h) - size + 1])


def chosen(keys: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` keys the position of its first least key."""
    return np.argmin(np.lib.stride_tricks.sliding_window_view(keys, span), axis=1) + np.arange(len(keys) - span + 1)


def sparse_suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, key) of kept positions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, key = [], [], []
            for r, text in enumerate(texts(batch)):
                h = word_hashes(text)
                if len(h) >= MIN_WORDS:
                    k = run_hashes(h, KEY)
                    at = np.unique(chosen(k, MIN_WORDS - KEY + 1))
                    rows.append(np.full(len(at), r))
                    pos.append(at.astype(np.int32))
                    key.append(k[at].view(np.int64))
            if rows:
                ids = batch.column("doc_id").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(pos)), pa.array(np.concatenate(key))], ["doc_id", "pos", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, pos int, key long")


def passages(marked: DataFrame) -> DataFrame:
    """marked(doc_id, text, at) to (doc_id, start, hash, check) of each MIN_WORDS passage around a position of ``at``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, start, full, check = [], [], [], []
            for r, (text, at) in enumerate(zip(texts(batch), batch.column("at").to_pylist())):
                h = word_hashes(text)
                if len(h) < MIN_WORDS:
                    continue
                s = np.flatnonzero(np.isin(chosen(run_hashes(h, KEY), MIN_WORDS - KEY + 1), at))
                rows.append(np.full(len(s), r))
                start.append(s.astype(np.int32))
                full.append(run_hashes(h, MIN_WORDS)[s].view(np.int64))
                with np.errstate(over="ignore"):
                    check.append(run_hashes(_mixed(h * np.uint64(_B)), MIN_WORDS)[s].view(np.int64))
            if rows:
                ids = batch.column("doc_id").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(x)) for x in (start, full, check))], ["doc_id", "start", "hash", "check"])

    return marked.mapInArrow(run, f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, start int, hash long, check long")


def commons(around: DataFrame) -> dict[tuple[int, int], tuple]:
    """Common passages by fingerprint: the first of their copies by (doc_id, start), and whether another document has them; at most COMMON_PART."""
    limit = max(COMMON_ROWS, around.count() // COMMON_PART)
    by = ["hash", "check"]
    counted = around.groupBy(*by).agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    common = written(counted.where(F.col("n") > limit), "common")
    named = F.broadcast(common.select(*(F.col(c).alias(f"c_{c}") for c in by), "a", "b"))
    firsts = around.join(named, (F.col("hash") == F.col("c_hash")) & (F.col("check") == F.col("c_check")) & (F.col("doc_id") == F.col("a")))
    rows = firsts.groupBy(*by).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.min("start").alias("start")).collect()
    return {(r["hash"], r["check"]): (r["a"], r["start"], r["a"] != r["b"]) for r in rows}


def again(around: DataFrame) -> DataFrame:
    """(doc_id, start, again) of passages that another document has; again: not the first of its copies by (doc_id, start)."""
    common = commons(around)
    order = sorted(common)
    keys = np.array([k for k, _ in order], dtype=np.int64)
    shared = around.sparkSession.sparkContext.broadcast((keys, [(k, *common[k]) for k in order]))
    by = ["hash", "check"]
    kind = around.schema["doc_id"].dataType.simpleString()

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with again, which is null unless the passage is common."""
        keys, found = shared.value
        for batch in batches:
            state = np.full(batch.num_rows, -1, dtype=np.int8)
            if len(keys) and batch.num_rows:
                h = batch.column("hash").to_numpy()
                at = np.searchsorted(keys, h)
                some = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h)
                doc, start, check = (batch.column(c).take(pa.array(some)).to_pylist() for c in ("doc_id", "start", "check"))
                for k, d, s, c in zip(some, doc, start, check):
                    for p in range(at[k], len(keys)):
                        key, first, begin, repeated = found[p]
                        if key[0] != h[k]:
                            break
                        if key[1] == c:
                            state[k] = (2 if (d, s) != (first, begin) else 1) if repeated else 0
            yield batch.append_column("state", pa.array(state))

    marked = around.mapInArrow(split, f"doc_id {kind}, start int, hash long, check long, state tinyint")
    known = marked.where("state > 0").select("doc_id", "start", (F.col("state") == 2).alias("again"))
    rest = marked.where("state = -1").drop("state").repartition(*by).sortWithinPartitions(*by, "doc_id", "start")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, by):
            ends = at[1:] if at[-1] == t.num_rows else np.append(at[1:], t.num_rows)
            at = at[: len(ends)]
            doc, start = t.column("doc_id").to_numpy(), t.column("start").to_numpy()
            head = np.repeat(at, ends - at)
            repeated = np.repeat(doc[at] != doc[ends - 1], ends - at)
            if repeated.any():
                later = (doc != doc[head]) | (start != start[head])
                yield from t.select(["doc_id", "start"]).append_column("again", pa.array(later)).filter(pa.array(repeated)).to_batches()

    return known.unionByName(rest.mapInArrow(run, f"doc_id {kind}, start int, again boolean"))


SPANS = "array<struct<s:int,e:int>>"


def _merge(found: DataFrame) -> DataFrame:
    """(doc_id, starts, later) to spans of all starts and of the later ones."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pa.array([[{"s": s, "e": e} for s, e in merged([(x, x + MIN_WORDS) for x in v])] for v in batch.column(c).to_pylist()], kind) for c in ("starts", "later")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *out], ["doc_id", "spans", "cuts"])

    return found.mapInArrow(run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, spans {SPANS}, cuts {SPANS}")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, cuts): word ranges, end exclusive, of passages of MIN_WORDS words or more that another document has too.

    ``cuts`` leaves out what occurs here first by (doc_id, position), so removing
    cuts keeps one copy. Documents without such a passage give no row, nor do null
    or short texts or rows without an id; rows that repeat a doc_id are one
    document. Passages that repeat only within one document don't count.
    """
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    suffixes = written(sparse_suffixes(docs), "suffixes")
    # Written, so that a join with it has plain shuffles on both sides, of which a hot key's can be split.
    shared = written(suffixes.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("key"), "shared")
    at = suffixes.join(shared, "key", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    around = written(passages(docs.join(at, "doc_id")), "passages")
    hits = again(around)
    per = hits.groupBy("doc_id").agg(F.collect_set("start").alias("starts"), F.collect_set(F.when(F.col("again"), F.col("start"))).alias("later"))
    return _merge(per)


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs without the words of their cuts; a changed text has its words joined by single spaces. Columns of any name stay."""
    cuts = repeated_spans(docs).where(F.size("cuts") > 0).select(F.col("doc_id").alias("id"), "cuts")
    x = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("doc"), F.col("text").alias("old"))
    x = x.join(cuts, x["doc"] == cuts["id"], "left")
    words = F.filter(F.split("old", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    ends = F.concat(F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), F.col("cuts"))
    starts = F.concat(F.col("cuts"), F.array(F.struct(F.lit(2**31 - 1).alias("s"), F.lit(2**31 - 1).alias("e"))))
    kept = F.flatten(F.zip_with(ends, starts, lambda a, b: F.slice(words, a["e"] + 1, F.least(b["s"], F.size(words)) - a["e"])))
    text = F.when(F.col("cuts").isNull(), F.col("old")).otherwise(F.array_join(kept, " "))
    return x.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def _spans_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT doc_id, count(*) AS n, sum(e - s) AS words, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM
(SELECT doc_id, min(s) AS s, max(s) + {MIN_WORDS} AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM
(SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {MIN_WORDS} THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY doc_id, g) GROUP BY doc_id)"""


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
p AS (SELECT doc_id, s, array_to_string(w[s + 1:s + {MIN_WORDS}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(0, len(w) - {MIN_WORDS} + 1)) AS s FROM d WHERE len(w) >= {MIN_WORDS})),
r AS (SELECT t, min(doc_id) AS a, min_by(s, (doc_id, s)) AS b FROM p GROUP BY t HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, s, doc_id <> a OR s <> b AS later FROM p JOIN r USING (t)),
{_spans_sql('x', 'hit')}, {_spans_sql('y', '(SELECT * FROM hit WHERE later)')}
SELECT doc_id, CAST(x.n AS INTEGER) AS n_spans, CAST(x.words AS INTEGER) AS n_repeated, CAST(coalesce(y.words, 0) AS INTEGER) AS n_cut, x.spans, coalesce(y.spans, '') AS cuts FROM x LEFT JOIN y USING (doc_id)
"""


def op8_repeats(spark, folder: str) -> DataFrame:
    found = repeated_spans(table(spark, folder, "documents"))
    length = lambda c: F.aggregate(c, F.lit(0), lambda acc, x: acc + x["e"] - x["s"])
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["s"], x["e"])), ",").alias(c)
    return found.select("doc_id", F.size("spans").alias("n_spans"), length("spans").alias("n_repeated"), length("cuts").alias("n_cut"), listed("spans"), listed("cuts"))
