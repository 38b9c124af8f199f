"""Benchmark decontamination with an FM-index per shard of training documents.

Words of a shard become symbols, zero being any word that no phrase has. Only
runs of non-zero symbols as long as the shortest phrase can hold an occurrence, so
the shard's text is those runs, zeros between them. Its suffix array gives the
Burrows-Wheeler transform, a wavelet matrix answers ranks on it, all phrases
are searched backwards together, and occurrences are located by walking to sampled
suffix positions. Overlapping occurrences merge into removal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.llm.common import packed, small_batches, table, texts, written

WINDOW = 13
#: Contaminated: hit words times SHARE reach all words.
SHARE = 20
#: Text of one block of phrases that is sent to every task.
BLOCK_BYTES = 4 << 20
JOB_BLOCKS = 8
SAMPLE = 8
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Phrases:
    """Distinct windows of items as rows of symbols, and the items of each window."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            w = words(text)
            for k in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[k : k + window]), set()).add(item)
        self.symbol: dict[bytes, int] = {}
        for p in found:
            for w in p:
                self.symbol.setdefault(w, len(self.symbol) + 1)
        self.items = list(found.values())
        self.length = np.array([len(p) for p in found], dtype=np.int64)
        self.rows = np.zeros((len(found), window), dtype=np.int64)
        for r, p in enumerate(found):
            self.rows[r, : len(p)] = [self.symbol[w] for w in p]


class WaveletMatrix:
    """Ranks of symbols in prefixes of a sequence."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        for b in reversed(range(self.bits)):
            bit = (s >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[k] before position i[k]."""
        lo, hi = np.zeros_like(i), i.copy()
        for level, ones in enumerate(self.ones):
            bit = (c >> (self.bits - 1 - level)) & 1
            zeros = len(ones) - 1 - ones[-1]
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the only smallest."""
    n, k = len(s), 1
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, k = new, 2 * k
        if rank.max() == n - 1 or k >= n:
            return order


class FMIndex:
    def __init__(self, s: np.ndarray, sigma: int):
        """Symbols from 1 on; a terminal 0 is added."""
        t = np.append(s, 0)
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=sigma + 1))])
        self.wavelet = WaveletMatrix(self.bwt, sigma + 1)
        self.marked = sa % SAMPLE == 0
        self.position = sa[self.marked].astype(np.int32)
        self.sampled = np.cumsum(self.marked, dtype=np.int32) - 1
        self.size = len(t)

    def search(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges [lo, hi) of all phrases."""
        lo, hi = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), self.size, dtype=np.int64)
        live = np.arange(len(rows))
        for step in range(rows.shape[1]):
            at = length[live] - 1 - step
            on = live[at >= 0]
            if not len(on):
                break
            c = rows[on, length[on] - 1 - step]
            lo[on] = self.before[c] + self.wavelet.rank(c, lo[on])
            hi[on] = self.before[c] + self.wavelet.rank(c, hi[on])
            live = on[hi[on] > lo[on]]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        at, steps, todo = rows.copy(), np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(todo := todo[~self.marked[at[todo]]]):
            c = self.bwt[at[todo]]
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
        return self.position[self.sampled[at]] + steps


def occurrences(docs: list[np.ndarray], phrases: Phrases) -> Iterator[tuple[int, int, int]]:
    """(document, word, phrase) of every occurrence in a shard of symbol arrays."""
    if not len(phrases.rows):
        return
    least = int(phrases.length.min())
    size = np.array([len(d) for d in docs], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    for d, f in zip(docs, first):
        flat[f : f + len(d)] = d
    inside = np.concatenate([[0], (flat != 0).astype(np.int8), [0]])
    starts, ends = (np.flatnonzero(np.diff(inside) == s) for s in (1, -1))
    long = ends - starts >= least
    if not long.any():
        return
    keep = np.zeros(len(flat) + 1, dtype=np.int64)
    np.add.at(keep, starts[long], 1)
    np.add.at(keep, ends[long] + 1, -1)  # with the zero after each run
    at = np.flatnonzero(np.cumsum(keep)[:-1] > 0)
    sigma = len(phrases.symbol) + 1
    index = FMIndex(flat[at] + 1, sigma)
    lo, hi = index.search(np.where(phrases.rows > 0, phrases.rows + 1, 0), phrases.length)
    hits = np.where(hi > lo, hi - lo, 0)
    which = np.repeat(np.arange(len(hits)), hits)
    rows = np.repeat(lo, hits) + np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits)
    where = at[index.locate(rows)]
    doc = np.searchsorted(first, where, side="right") - 1
    yield from zip(doc.tolist(), (where - first[doc]).tolist(), which.tolist())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


FOUND = "_words long, _spans array<struct<s:int,e:int>>, _items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with _words, _spans (merged word ranges, end exclusive) and _items (ids as text, sorted).

    The phrases come to the driver and go out in blocks of about BLOCK_BYTES of
    item text, however large the benchmark is; each block is a pass
    of the same rows through one more map stage, without a shuffle, and after JOB_BLOCKS of them
    the rows are written, so no job holds more. Columns of docs that are called _words, _spans or _items are replaced. Null or empty
    texts have no words and no hits; an item without words has no window, one with a
    null id counts hits but isn't listed. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    docs = docs.select(*(c for c in docs.columns if c not in ("_words", "_spans", "_items")))
    names = docs.columns
    out = docs.withColumns({"_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<struct<s:int,e:int>>"), "_items": F.array().cast("array<string>")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + FOUND
    dealt = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    for b in range(blocks):
        if b and b % JOB_BLOCKS == 0:
            out = written(out, "contamination")
        items = [(r["item"], bytes(r["text"])) for r in dealt.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]
        shared = spark.sparkContext.broadcast(Phrases(items, window))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            get = phrases.symbol.get
            for batch in batches:
                tokens = [words(x) for x in texts(batch)]
                symbols = [np.fromiter((get(w, 0) for w in t), dtype=np.int64, count=len(t)) for t in tokens]
                spans = [[(x["s"], x["e"]) for x in v] for v in batch.column("_spans").to_pylist()]
                found = [set(v) for v in batch.column("_items").to_pylist()]
                for d, k, p in occurrences(symbols, phrases):
                    spans[d].append((k, k + int(phrases.length[p])))
                    found[d].update(i for i in phrases.items[p] if i is not None)
                span = pa.array([[{"s": s, "e": e} for s, e in merged(x)] for x in spans], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(t) for t in tokens], pa.int64()), span, pa.array([sorted(x) for x in found], pa.list_(pa.string()))], [*names, "_words", "_spans", "_items"])

        out = out.mapInArrow(run, schema)
    return out


def hit_words():
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])


def is_contaminated():
    return (hit_words() > 0) & (SHARE * hit_words() >= F.col("_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones; the rest stays as it is, columns of any name included."""
    rows = docs.select(packed(docs).alias("row"), "text")
    return contamination(rows, benchmark).where(~is_contaminated()).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_decontaminate(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit_words().alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents), i AS (SELECT item_id, {_W} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS l, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda s: array_to_string(w[s:s + 12], ' '))) AS g FROM i WHERE len(w) > 0),
starts AS (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM win) WHERE len(w) >= l),
occ AS (SELECT doc_id, s, s + g.l AS e, item_id FROM (SELECT doc_id, s, l, array_to_string(w[s:s + l - 1], ' ') AS g FROM starts) g JOIN win USING (l, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, e)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
