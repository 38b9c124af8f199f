"""Katz backoff language model over words, of order two.

Counts and scores move through the cluster as packed blocks: the hashes of a batch
of documents are sorted and cut into buckets, so a shuffle carries one row per
batch and bucket instead of one per word. A pair is counted in the bucket of its
second word, where that word's own count is the sum over its pairs; pairs of words
that a large share of all tokens are (``heavy``) are spread by both words. Counts
are stored as one table, weights per history as another, both partitioned.

P(w | h) = d(c) c(h, w) z(h) / c(h)   for a pair that was seen,
           alpha(h) P(w)              else, and P(w) recurses to single words the same way.

alpha(h) is the mass left at
h over the mass that single words have outside the pairs of h, so each history's
probabilities, that of an unknown word included, sum to exactly one. Pairs of every
count are kept, those seen once with their Good-Turing discount.

Null and empty texts are one end token; rows that repeat count again; an empty table
gives a model in which every word is unknown. Texts of any length go whole into one packed batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from quern.llm.common import crc_mod, small_batches, table, texts, written

#: Good-Turing discounts hold for counts up to this one.
DISCOUNTED = 5
#: Tokens of one packed batch, and its most documents, which have 16 bits to be numbered in.
BATCH_TOKENS, BATCH_DOCS = 1_000_000, 60_000
#: Text bytes per shuffle partition, and buckets per partition.
PARTITION_BYTES, SPREAD = 24 << 20, 2
#: A word that holds this share of the tokens of one document in HEAVY_SAMPLE has its pairs spread. This decides only where a pair is counted.
HEAVY_SHARE, HEAVY_SAMPLE = 1 / 1024, 64
#: Keys of at least this share of all tokens are looked up where the documents are; there are at most 2 / share of them.
HOT_SHARE = 1 / 262144
ADD = 0.1
END, START = (np.uint64(xxhash.xxh64_intdigest(x, 9)) for x in (b"<end>", b"<start>"))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + _mixed(w))


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the words, then one end; A-Z in lower case."""
    w = text.lower().split()
    return np.append(np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w)), END)


def histories(t: np.ndarray) -> np.ndarray:
    return np.concatenate([[START], t[:-1]])


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block; bytes of like weight stand together, which compresses sorted numbers."""
    parts = []
    for a in arrays:
        if a.dtype == np.uint64 and len(a) and (a[1:] >= a[:-1]).all():
            a, kind = np.diff(a, prepend=np.uint64(0)), b"d"
        else:
            kind = b"p"
        body = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
        parts.append((kind + a.dtype.str[1:].encode().ljust(3), len(a), body))
    head = b"".join(k + n.to_bytes(8, "little") for k, n, _ in parts)
    raw = len(parts).to_bytes(1, "little") + head + b"".join(b for *_, b in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(block: bytes) -> list[np.ndarray]:
    raw = pa.decompress(block[8:], int.from_bytes(block[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 1 + 12 * raw[0]
    for k in range(raw[0]):
        head = raw[1 + 12 * k : 13 + 12 * k]
        dtype, n = np.dtype("<" + head[1:4].decode().strip()), int.from_bytes(head[4:], "little")
        size = n * dtype.itemsize
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n).T).reshape(-1).view(dtype) if n else np.zeros(0, dtype)
        out.append(np.cumsum(a, dtype=np.uint64) if head[:1] == b"d" else a)
        at += size
    return out


#: Rows of every exchange and table. In a bucket, batches order the rows: counts, then weights, then queries from 0 on.
BLOCKS = "bucket int, kind string, batch long, block binary"
COUNTS, WEIGHTS, GAINS = -(1 << 60), -(1 << 59), -(1 << 58)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["bucket", "kind", "batch", "block"])


def _edges(buckets: int) -> np.ndarray:
    return np.array([(b << 64) // buckets for b in range(1, buckets)], dtype=np.uint64)


def _cut(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, start, end) of the buckets that sorted keys fall in; a bucket is a range of hashes."""
    at = np.concatenate([[0], np.searchsorted(keys, _edges(buckets)), [len(keys)]])
    return ((b, i, j) for b, (i, j) in enumerate(zip(at.tolist(), at[1:].tolist())) if j > i)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(_edges(buckets), keys, side="right").astype(np.int32)


def _place(h: np.ndarray, w: np.ndarray, heavy: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each pair: that of its word, or of the pair if the word is heavy."""
    return _bucket(np.where(np.isin(w, heavy), pair_key(h, w), w), buckets)


def _by_bucket(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    return order, [(b, i, j) for b, (i, j) in enumerate(zip(at, at[1:])) if j > i]


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], pa.Table]]:
    """Token arrays of enough documents for a packed batch, with their rows."""
    held: list[np.ndarray] = []
    rows: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            held += [tokens(x) for x in texts(part)]
            rows.append(part.select([c for c in part.schema.names if c != "text"]))
            size += sum(map(len, held[-part.num_rows :]))
            if size >= BATCH_TOKENS or len(held) >= BATCH_DOCS:
                yield held, pa.Table.from_batches(rows)
                held, rows, size = [], [], 0
    if held:
        yield held, pa.Table.from_batches(rows)


def _sum_pairs(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by w, then h."""
    order = np.lexsort((h, w))
    h, w, c = h[order], w[order], c[order]
    at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[at], w[at], np.add.reduceat(c, at) if len(at) else c


def _columns(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs sorted by w: the words, their runs of pairs, the histories, and which of those each pair has."""
    at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
    hs, of = np.unique(h, return_inverse=True)
    return w[at], np.diff(np.append(at, len(w))).astype(np.uint32), hs, of.astype(np.uint16 if len(hs) <= 1 << 16 else np.uint32)


def _pack_pairs(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    return _pack(*_columns(h, w), c.astype(np.uint32) if c.max() < 1 << 32 else c.astype(np.int64))


class Pairs:
    """The unpacked counts of a bucket: words and their runs of pairs, histories and where each pair's stands."""

    def __init__(self, block: bytes):
        self.words, runs, self.histories, self.of, c = _unpack(block)
        self.c = c.astype(np.int64)
        self.word = np.repeat(np.arange(len(self.words)), runs)

    def counts(self, heavy: np.ndarray, heavy_counts: np.ndarray) -> np.ndarray:
        """How often each word occurs in all."""
        own = np.bincount(self.word, weights=self.c, minlength=len(self.words)).astype(np.int64)
        if len(heavy):
            at = np.minimum(np.searchsorted(heavy, self.words), len(heavy) - 1)
            own = np.where(heavy[at] == self.words, heavy_counts[at], own)
        return own


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "batch", "block")))


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[str, int, bytes]]]]:
    """The rows of each bucket, which stand together."""
    last, held = None, []
    for bucket, *row in _in_order(batches):
        if bucket != last and held:
            yield last, held
            held = []
        last = bucket
        held.append(tuple(row))
    if held:
        yield last, held


def discounts(n: dict[int, int]) -> np.ndarray:
    """Katz's d(1) .. d(DISCOUNTED) from counts of counts, (r - 1/2) / r where they give none in (0, 1]; 1 on either side."""
    out = np.ones(DISCOUNTED + 2)
    top = (DISCOUNTED + 1) * n.get(DISCOUNTED + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, DISCOUNTED + 1):
        star = (r + 1) * n.get(r + 1, 0) / n[r] if n.get(r) else 0.0
        d = (star / r - top) / (1 - top) if top < 1 else 0.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.minimum(c, DISCOUNTED + 1)]


def _single(c: np.ndarray, d: np.ndarray, scale: float) -> np.ndarray:
    return discounted(c, d) * scale


def partitions(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(8, -(-int(size) // PARTITION_BYTES))


def dealt(rows: DataFrame, parts: int, key: str = "bucket") -> DataFrame:
    """Every partition has as many buckets (or batches) as any other, give or take one."""
    return rows.repartitionById(parts, F.pmod(key, F.lit(parts)).cast("int"))


def heavy_words(train: DataFrame) -> np.ndarray:
    """Sorted words of a large share of a sample of whole documents; at most 2 / HEAVY_SHARE for each that is large by itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, _ in _batches(batches):
            t = np.concatenate(held)
            w, c = np.unique(t, return_counts=True)
            large = c >= max(2, len(t) * HEAVY_SHARE / 2)
            rows = pa.array(np.append(w[large], np.uint64(0)).view(np.int64)), pa.array(np.append(c[large], len(t)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.append(np.zeros(large.sum(), bool), True))], ["w", "c", "all_tokens"])

    sample = train.select("text").where(F.pmod(F.xxhash64("text"), F.lit(HEAVY_SAMPLE)) == 0)
    found = sample.mapInArrow(run, "w long, c long, all_tokens boolean").groupBy("w", "all_tokens").agg(F.sum("c").alias("c"))
    total = found.where("all_tokens").select(F.col("c").alias("total"))
    # One row, so its broadcast is bounded.
    large = found.where("NOT all_tokens").join(F.broadcast(total)).where(F.col("c") >= F.col("total") * HEAVY_SHARE).select("w").toArrow()
    return np.sort(large.column("w").to_numpy().view(np.uint64))


class Katz:
    """A fitted model: tables of counts and of weights, and the few numbers that every task needs."""

    def __init__(self, train: DataFrame):
        """train(text), null as empty."""
        self.spark: SparkSession = train.sparkSession
        small_batches(self.spark)
        self.parts = partitions(train)
        self.buckets = SPREAD * self.parts
        self.heavy = heavy_words(train)
        merged = dealt(self._count(train), self.parts).sortWithinPartitions("bucket")
        self.counts = written(self._merge(merged), "ngrams", by="ord")
        # At most 2 * (DISCOUNTED + 1) spectrum rows, the heavy words, and two totals.
        found = self.counts.where("ord = 0").groupBy("kind", "a").agg(F.sum("n").alias("n")).collect()
        n = {k: {r["a"]: r["n"] for r in found if r["kind"] == k} for k in ("words", "pairs", "heavy", "tokens", "types", "all pairs")}
        self.heavy_counts = np.array([n["heavy"].get(int(w), 0) for w in self.heavy.view(np.int64)], dtype=np.int64)
        for c in self.heavy_counts[self.heavy_counts <= DISCOUNTED + 1].tolist():
            n["words"][c] = n["words"].get(c, 0) + 1
        self.total, self.n_pairs = n["tokens"].get(0, 0), n["all pairs"].get(0, 0)
        self.types = n["types"].get(0, 0) + int((self.heavy_counts > 0).sum())
        self.d1, self.d2 = discounts(n["words"]), discounts(n["pairs"])
        kept = self.total - sum(n["words"].get(r, 0) * r * (1 - self.d1[r]) for r in range(1, DISCOUNTED + 1))
        # What is left for unknown words; at least what one more token would be.
        self.unknown = max(1 - kept / self.total, 1 / (self.total + 1)) if self.total else 1.0
        self.scale = (1 - self.unknown) / kept if self.total else 1.0
        #: P(w) of words by their counts.
        self.single = partial(_single, d=self.d1, scale=self.scale)
        self.weights = written(self._weigh(), "weights", by="kind")

    def _count(self, train: DataFrame) -> DataFrame:
        buckets, heavy = self.buckets, self.heavy

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for docs, _ in _batches(batches):
                t = np.concatenate(docs)
                h, w, c = _sum_pairs(np.concatenate([histories(d) for d in docs]), t, np.ones(len(t), dtype=np.int64))
                order, cut = _by_bucket(_place(h, w, heavy, buckets), buckets)
                h, w, c = h[order], w[order], c[order]
                yield _rows([(b, "pairs", 0, _pack_pairs(h[i:j], w[i:j], c[i:j])) for b, i, j in cut])

        return train.select("text").mapInArrow(run, BLOCKS)

    def _merge(self, blocks: DataFrame) -> DataFrame:
        """Blocks of merged counts (ord 2) and figures (ord 0)."""
        heavy = self.heavy

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _grouped(batches):
                parts = [Pairs(block) for *_, block in rows]
                h, w, c = _sum_pairs(*(np.concatenate(x) for x in zip(*((p.histories[p.of], p.words[p.word], p.c) for p in parts))))
                del parts
                word, own = np.unique(w, return_inverse=True)
                own = np.bincount(own, weights=c).astype(np.int64)
                large = np.isin(word, heavy)
                figures = [("tokens", 0, int(c.sum())), ("types", 0, int((~large).sum())), ("all pairs", 0, len(c))]
                figures += [("heavy", a, n) for a, n in zip(word[large].view(np.int64).tolist(), own[large].tolist())]
                for kind, x in (("words", own[~large]), ("pairs", c)):
                    figures += [(kind, r, n) for r, n in enumerate(np.bincount(x[x <= DISCOUNTED + 1], minlength=1).tolist()) if r and n]
                m = len(figures)
                columns = [[bucket] * (m + 1), [k for k, *_ in figures] + ["block"], [a for _, a, _ in figures] + [0], [n for *_, n in figures] + [0], [None] * m + [_pack_pairs(h, w, c)], [0] * m + [2]]
                types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["bucket", "kind", "a", "n", "block", "ord"])

        return blocks.mapInArrow(run, "bucket int, kind string, a long, n long, block binary, ord int")

    def _count_blocks(self) -> DataFrame:
        return self.counts.where("ord = 2").select("bucket", F.lit("pairs").alias("kind"), F.lit(COUNTS).alias("batch"), "block")

    def _weigh(self) -> DataFrame:
        """Weights of each history ("weights", in its bucket), and what each bucket of pairs needs of its histories ("gains", in order of its histories)."""
        buckets, heavy, heavy_counts, single, d2 = self.buckets, self.heavy, self.heavy_counts, self.single, self.d2

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, _, _, block in _in_order(batches):
                p = Pairs(block)
                p1 = single(p.counts(heavy, heavy_counts))[p.word]
                ch, kept, p1 = (np.bincount(p.of, weights=x, minlength=len(p.histories)) for x in (p.c, discounted(p.c, d2), p1))
                yield _rows([(b, "sums", bucket, _pack(p.histories[i:j], ch[i:j].astype(np.int64), kept[i:j], p1[i:j])) for b, i, j in _cut(p.histories, buckets)])

        def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _grouped(batches):
                sums = [_unpack(block) for *_, block in rows]
                h, of = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
                ch, kept, p1 = (np.bincount(of, weights=np.concatenate([s[k] for s in sums])) for k in (1, 2, 3))
                left = np.maximum(1 - kept / ch, 1 / (ch + 1))
                z, alpha = (1 - left) * ch / kept, left / (1 - p1)
                gain = np.log10(z / ch) - np.log10(alpha)
                ends = np.cumsum([len(s[0]) for s in sums])
                yield _rows([(bucket, "weights", WEIGHTS, _pack(h, alpha)), *((to, "gains", GAINS + bucket, _pack(gain[at])) for (_, to, _), at in zip(rows, np.split(of, ends[:-1])))])

        asked = self._count_blocks().mapInArrow(ask, BLOCKS)
        return dealt(asked, self.parts).sortWithinPartitions("bucket", "batch").mapInArrow(answer, BLOCKS)

    def _model(self) -> DataFrame:
        return self._count_blocks().unionByName(self.weights)

    def _lookups(self):
        """A function from the model's rows of a bucket to sorted keys, their counts (0 for pairs), how often they occur, and their values.

        Values are what a token adds to the score of a text of unknown words alone: a word its own log over an
        unknown word's, and its alpha as history of the next; a pair what it has over backing off.
        """
        buckets, heavy, heavy_counts, single, d2, unknown = self.buckets, self.heavy, self.heavy_counts, self.single, self.d2, self.unknown

        def made(bucket: int, rows: list[tuple[str, int, bytes]]) -> list[np.ndarray]:
            word, c = heavy[home := _bucket(heavy, buckets) == bucket], heavy_counts[home]
            key, often, value = (np.zeros(0, t) for t in (np.uint64, np.int64, np.float64))
            blocks = [block for kind, _, block in rows if kind == "pairs"]
            if blocks:
                p = Pairs(blocks[0])
                own = p.counts(heavy, heavy_counts)
                gains = np.concatenate([_unpack(block)[0] for kind, _, block in rows if kind == "gains"])
                key, often = pair_key(p.histories[p.of], p.words[p.word]), p.c
                value = np.log10(discounted(p.c, d2)) + gains[p.of] - np.log10(single(own))[p.word]
                here = ~np.isin(p.words, heavy)
                word, c = np.concatenate([word, p.words[here]]), np.concatenate([c, own[here]])
            v = np.log10(single(c)) - np.log10(unknown)
            for block in (block for kind, _, block in rows if kind == "weights"):
                h, alpha = _unpack(block)
                at = np.minimum(np.searchsorted(h, word), len(h) - 1)
                v = v + np.where(h[at] == word, np.log10(alpha[at]), 0.0)
            key = np.concatenate([_mixed(word), key])
            order = np.argsort(key)
            return [key[order], np.concatenate([c, np.zeros(len(often), np.int64)])[order], np.concatenate([c, often])[order], np.concatenate([v, value])[order]]

        return made

    def _start_alpha(self) -> float:
        """log10 alpha of the start, which every text has once."""
        home = int(_bucket(np.array([START]), self.buckets)[0])
        for (block,) in self.weights.where((F.col("kind") == "weights") & (F.col("bucket") == home)).select("block").collect():
            h, alpha = _unpack(block)
            found = alpha[h == START]
            if len(found):
                return float(np.log10(found[0]))
        return 0.0

    def _hot(self, least: int) -> list[np.ndarray]:
        """Sorted keys, counts and values of heavy words, and of words and pairs that occur ``least`` times or more."""
        made, heavy = self._lookups(), _mixed(self.heavy)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in _grouped(batches):
                key, c, often, v = made(bucket, rows)
                top = (often >= least) | np.isin(key, heavy)
                yield pa.RecordBatch.from_arrays([pa.array(key[top].view(np.int64)), pa.array(c[top]), pa.array(v[top])], ["key", "c", "v"])

        found = dealt(self._model(), self.parts).sortWithinPartitions("bucket", "batch").mapInArrow(run, "key long, c long, v double")
        rows = written(found, "hot").toArrow()
        key, c, v = rows.column("key").to_numpy().view(np.uint64), rows.column("c").to_numpy(), rows.column("v").to_numpy()
        key, at = np.unique(key, return_index=True)
        return [key, c[at], v[at]]

    def score(self, docs: DataFrame) -> DataFrame:
        """docs(doc_id, text) to (doc_id, n_tokens, n_known, base_score, score), one row per row. Null texts count as empty: one end token."""
        spark, buckets, heavy, made = self.spark, self.buckets, self.heavy, self._lookups()
        small_batches(spark)
        least = max(1, int(self.total * HOT_SHARE))
        shared = spark.sparkContext.broadcast(self._hot(least))
        add = float(np.log10(ADD))

        def gains(c: np.ndarray) -> np.ndarray:
            return np.where(c > 0, np.log10(c + ADD) - add, 0.0)

        def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId() << 33
            hot_key, hot_c, hot_v = shared.value

            def find(key: np.ndarray) -> np.ndarray:
                """Where keys stand in the hot ones, -1 if they don't."""
                if not len(hot_key):
                    return np.full(len(key), -1)
                at = np.minimum(np.searchsorted(hot_key, key), len(hot_key) - 1)
                return np.where(hot_key[at] == key, at, -1)

            for k, (held, rows) in enumerate(_batches(batches)):
                batch = part + k
                size = np.array([len(d) for d in held])
                t, h = np.concatenate(held), np.concatenate([histories(d) for d in held])
                doc = np.repeat(np.arange(len(held)), size)
                word, pair = find(_mixed(t)), find(pair_key(h, t))
                total = lambda at, x: np.bincount(doc[at >= 0], weights=x[at[at >= 0]], minlength=len(held))  # noqa: B023,E731
                ids = rows.column("doc_id").combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as w:
                    w.write_batch(pa.RecordBatch.from_arrays([ids], ["doc_id"]))
                # A pair is no more frequent than its word, so of a known pair the word is known too.
                sums = _pack(np.arange(len(held)).astype(np.uint32), total(word, hot_v) + total(pair, hot_v), total(word, gains(hot_c)), total(word, hot_c > 0).astype(np.uint32), size.astype(np.uint32))
                out = [(k % buckets, "ids", batch, sink.getvalue().to_pybytes()), (k % buckets, "sums", batch, sums)]
                t, h, doc = t[pair < 0], h[pair < 0], doc[pair < 0]
                bucket = _place(h, t, heavy, buckets)
                order = np.lexsort((h, t, bucket))
                t, h, doc, bucket = t[order], h[order], doc[order].astype(np.uint16), bucket[order]
                at = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
                for b, (i, j) in enumerate(zip(at, at[1:])):
                    if j > i:
                        out.append((b, "asked", batch, _pack(*_columns(h[i:j], t[i:j]), doc[i:j])))
                yield _rows(out)

        def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, model, found = None, [], None
            for bucket, kind, batch, block in _in_order(batches):
                if bucket != last:
                    last, model, found = bucket, [], None
                if batch < 0:
                    model.append((kind, batch, block))
                elif kind != "asked":
                    yield _rows([(0, kind, batch, block)])
                else:
                    if found is None:
                        found, model = made(bucket, model), []
                    key, c, often, v = found
                    if not len(key):
                        continue
                    words, runs, hs, of, doc = _unpack(block)
                    # Words that the hot table has were counted by the asker.
                    word = np.searchsorted(key, _mixed(words)).clip(max=len(key) - 1)
                    own = (key[word] == _mixed(words)) & (often[word] < least) & ~np.isin(words, heavy)
                    asked = pair_key(hs[of], np.repeat(words, runs))
                    pair = np.searchsorted(key, asked).clip(max=len(key) - 1)
                    seen = key[pair] == asked
                    word, own = np.repeat(word, runs), np.repeat(own, runs)
                    if own.any() or seen.any():
                        ids, of = np.unique(doc, return_inverse=True)
                        total = lambda hit, x: np.bincount(of[hit], weights=x, minlength=len(ids))  # noqa: B023,E731
                        counts = c[word[own]]
                        yield _rows([(0, "sums", batch, _pack(ids.astype(np.uint32), total(own, v[word[own]]) + total(seen, v[pair[seen]]), total(own, gains(counts)), total(own, counts > 0).astype(np.uint32), np.zeros(len(ids), np.uint32)))])

        kind = docs.schema["doc_id"].dataType.simpleString()

        def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, sums = {}, {}
            for _, kind, batch, block in _in_order(batches):
                if kind == "ids":
                    ids[batch] = pa.ipc.open_stream(block).read_all().column("doc_id").combine_chunks()
                else:
                    sums.setdefault(batch, []).append(block)
            for batch, blocks in sums.items():
                total = [np.zeros(len(ids[batch])) for _ in range(4)]
                for block in blocks:
                    at, *some = _unpack(block)
                    for into, x in zip(total, some):
                        into[at] += x
                v, g, known, size = total
                yield pa.RecordBatch.from_arrays([ids[batch], pa.array(size.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(g), pa.array(v)], ["doc_id", "n_tokens", "n_known", "g", "v"])

        asked = docs.select("doc_id", "text").mapInArrow(ask, BLOCKS)
        tasks = max(self.parts, partitions(docs))
        answered = dealt(asked.unionByName(self._model()), self.parts).sortWithinPartitions("bucket", "batch").mapInArrow(answer, BLOCKS)
        sums = answered.repartition(tasks, "batch").mapInArrow(gather, f"doc_id {kind}, n_tokens long, n_known long, g double, v double")
        floor = add - float(np.log10(self.total + ADD * (self.types + 1)))
        alone = float(np.log10(self.unknown))
        return sums.select("doc_id", "n_tokens", "n_known", (F.col("n_tokens") * floor + F.col("g")).alias("base_score"), (F.col("n_tokens") * alone + F.col("v") + self._start_alpha()).alias("score"))


def op3_katz(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod("doc_id", 10) == 0, F.lit(False))
    model = Katz(docs.where(~held))
    found = model.score(docs)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
