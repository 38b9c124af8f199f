"""Near copies by Jaccard similarity of word shingles, through an inverted index of SimHash fingerprint bytes.

A fingerprint has 8 * PLACES bits, each the majority of one bit over the hashes of a
text's shingles; two sets of equal size at ALIKE differ in a bit with chance 0.1515 and
agree in a byte with chance 0.269. As in ``simhash``, posting lists are keyed by three
positional bytes. A text is posted under those POSTED of TRIPLES whose bits its own sums
hold furthest from a tie: near copies agree in most of them where they agree at all, and
texts that aren't alike seldom post the same ones. A key brings TAGGED more bits along, of other bytes, and a list of two texts
that differ in over APART of them is one by chance. Of pairs that share a list the equal positional bytes are tallied,
and those with LEAST_SAME or more are verified on their shingles. First each text meets
the least of its lists that it shares most with; what that leaves apart meets in pairs
of bounded blocks, of a cluster of texts that share many lists or else of a list, first
the best pair of two groups, then all pairs of groups that are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from quern.llm.common import groups, packed, small_batches, texts, written
from quern.llm.components import joined
from quern.llm.repeats import _mixed, run_hashes, word_hashes

SHINGLE = 5
#: Least Jaccard similarity of a link, as a ratio of whole numbers.
ALIKE = (4, 5)
#: Bytes of a fingerprint and of a key; lists of texts that are dealt at a time are those of one in ROUNDS of TRIPLES.
PLACES, PART, POSTED, ROUNDS = 240, 3, 480, 4
#: Small sets, whose bits tie more, post FEW over their size if that is more.
FEW = 10_000
#: Of 240 bytes, 64 are equal on average at ALIKE, and 45 of sets of four and five shingles, which tie most; fewer than 18 with chance below 1e-6.
LEAST_SAME = 18
#: Texts that share so many lists with a cluster are of it; clusters are gathered in so many steps.
CLOSE, GATHER = 4, 3
#: Bits of other bytes that a key brings along; at ALIKE over APART of them differ in one of 200 lists, in unlike texts with chance 0.94. Sets of up to SMALL shingles are exempt: their bits tie more, and of pairs of four and five some share one list only.
TAGGED, APART, SMALL = 27, 9, 5
BLOCK = 256
BINS = 512
#: Groups of so few rows are tallied at once.
FEW_ROWS = 16
_G = np.random.default_rng(42)
_FLIP, _SPREAD = (_G.integers(1 << 63, size=PLACES // 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
#: Each byte is in 24 of them.
TRIPLES = np.concatenate([_G.permutation(PLACES).reshape(-1, PART) for _ in range(24)])
#: By distance from a tie in hundredths of a standard deviation: -1e5 times the log of the chance that an equally large set at ALIKE agrees in the bit.
_UNSURE = np.array([-1e5 * math.log(0.5 * (1 + math.erf(z / 100 * 8 / math.sqrt(2 * (81 - 64))))) for z in range(600)]).astype(np.int64)


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted hashes of the distinct runs of SHINGLE words; a shorter text is one shingle, one without words none."""
    return np.unique(run_hashes(h, min(SHINGLE, len(h)))) if len(h) else h


def ones(s: np.ndarray) -> np.ndarray:
    """For each bit of a fingerprint, how many of a set's hashes have it."""
    found = np.zeros(8 * PLACES, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 255):
            bits = np.unpackbits(_mixed((s[k : k + 255, None] ^ _FLIP) * _SPREAD).view(np.uint8), axis=1)
            found += bits.sum(axis=0, dtype=np.uint8)
    return found


def fingerprint(s: np.ndarray) -> tuple[bytes, bytes]:
    """SimHash of a set that isn't empty, a bit being 1 if set in over half the hashes, and the surest of TRIPLES, as bits."""
    lead = 2 * ones(s) - len(s)
    unsure = _UNSURE[np.minimum(np.abs(lead) * (100 / math.sqrt(len(s))), len(_UNSURE) - 1).astype(np.int64)]
    of = unsure.reshape(-1, 8).sum(axis=1)[TRIPLES].sum(axis=1) * len(TRIPLES) + np.arange(len(TRIPLES))
    sure = np.zeros(len(TRIPLES), dtype=bool)
    sure[np.argsort(of)[: max(POSTED, FEW // len(s))]] = True
    return np.packbits(lead > 0).tobytes(), np.packbits(sure).tobytes()


def bins(s: np.ndarray) -> bytes:
    """One byte of the least hash in each of BINS ranges of hashes, zero where there is none.

    Where two sets' bytes differ, they differ in a shingle of that range, so sets of
    a and b shingles that reach ALIKE differ in at most (a + b) / 9 bytes: what
    differs in more is no link, whatever the hashes.
    """
    h = np.sort(_mixed(s))
    at = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.append(True, at[1:] != at[:-1])[: len(h)]
    out = np.zeros(BINS, dtype=np.uint8)
    out[at[first]] = 1 + h[first] % np.uint64(255)
    return out.tobytes()


def keys(marks: np.ndarray, sure: np.ndarray, turn: int = 0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the triples of one turn that rows of marks and sure post: the triple's number, then its bytes."""
    row, t = np.nonzero(np.unpackbits(sure, axis=1)[:, turn::rounds])
    t = t * rounds + turn
    key = t.astype(np.int64)
    for k in range(PART):
        key = (key << 8) | marks[row, TRIPLES[t, k]]
    return row, key


def tagged(marks: np.ndarray, row: np.ndarray, key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows and keys of ``keys`` as one long: the key, TAGGED bits of the two triples after its own of the same permutation, and whether the set is of SMALL size."""
    t, each = key >> (8 * PART), PLACES // PART
    of = [TRIPLES[t - t % each + (t + k) % each] for k in (1, 2)]
    tag = np.zeros(len(key), dtype=np.int64)
    for k in range(-(-TAGGED // 8)):
        tag = (tag << 8) | marks[row, of[k // PART][:, k % PART]]
    return (key << TAGGED | tag & ((1 << TAGGED) - 1)) << 1 | (size <= SMALL)


def sketches(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, th, node, marks, sure, bins, size); texts of the same words are one node, th is the hash of the very text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, marks, sure, ranges, size = [], [], [], [], []
            for t in texts(batch):
                h = word_hashes(t)
                s = shingle_set(h)
                f = fingerprint(s) if len(h) else (b"", b"")
                ranges.append(bins(s))
                size.append(len(s))
                node.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                marks.append(f[0])
                sure.append(f[1])
            nodes = pa.array(np.array(node, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), nodes, pa.array(marks, pa.binary()), pa.array(sure, pa.binary()), pa.array(ranges, pa.binary()), pa.array(size, pa.int64())], ["doc_id", "th", "node", "marks", "sure", "bins", "size"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"doc_id {kind}, th long, node long, marks binary, sure binary, bins binary, size long")


def shared(classes: DataFrame) -> DataFrame:
    """classes(node, marks, sure, size, root) to (key, node, root, v) of the lists that hold two roots or more, v being the least root of a list; without a column of roots a node is its own, and none is given.

    Lists of two nodes, none of them small, whose tags differ in over APART bits are left out: unlike texts share a list with
    chance 7e-6 a pair, which makes far more such lists than there are near copies. Lists of one round are dealt at a time, so that disk holds the shuffle of one round, and most lists, of one node, are never written.
    """

    roots = ["root"] if "root" in classes.columns else []

    def of(turn: int) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    marks = _bytes(batch.column("marks"))
                    size = batch.column("size").to_numpy()
                    row, key = keys(marks, _bytes(batch.column("sure"), len(TRIPLES) // 8), turn, ROUNDS)
                    named = [batch.column(c).take(pa.array(row)) for c in ("node", *roots)]
                    yield pa.RecordBatch.from_arrays([pa.array(tagged(marks, row, key, size[row])), *named], ["tagged", "node", *roots])

        posted = classes.where("size > 0").select("node", "marks", "sure", "size", *roots).mapInArrow(run, ", ".join(f"{c} long" for c in ("tagged", "node", *roots)))
        alone, key = Window.partitionBy("key"), F.shiftright("tagged", TAGGED + 1)
        root = F.col(*roots or ["node"])
        # Dealt before the key is a column of its own, so that it isn't shuffled.
        ends = posted.repartition(key).select("*", key.alias("key")).withColumns({"v": F.min(root).over(alone), "_v": F.max(root).over(alone), "_n": F.count("*").over(alone), "_a": F.min("tagged").over(alone), "_b": F.max("tagged").over(alone)})
        # Nodes of a list are distinct, and of two rows the least and the greatest tag are both.
        near = F.bit_count(F.shiftright(F.col("_a").bitwiseXOR(F.col("_b")), 1)) <= APART
        small = F.col("_a").bitwiseOR(F.col("_b")).bitwiseAND(1) == 1
        return written(ends.where((F.col("v") < F.col("_v")) & ((F.col("_n") > 2) | near | small)).select("key", "node", *roots, "v"), "lists")

    return reduce(DataFrame.unionByName, map(of, range(ROUNDS)))


def _bytes(column: pa.ChunkedArray | pa.Array, width: int = PLACES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), width)


def _sides(pairs: DataFrame, of: DataFrame, column: str) -> DataFrame:
    """pairs(u, v) with a column of of(node, ...) for u and for v, whose name gets the end's."""
    side = lambda end: of.select(F.col("node").alias(end), F.col(column).alias(f"{column}_{end}"))
    return pairs.join(side("u"), "u").join(side("v"), "v")


def tallied(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of pairs(u, v) those that share enough of marks(node, marks)."""

    def same(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_bytes(batch.column("marks_u")) == _bytes(batch.column("marks_v"))).sum(axis=1) >= LEAST_SAME
                yield batch.select(["u", "v"]).filter(pa.array(near))

    return _sides(pairs, marks, "marks").mapInArrow(same, "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame) -> DataFrame:
    """Of pairs(u, v) those whose similarity reaches ALIKE, by the texts of docs(text) that named(node, th) names."""

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, b = None, np.zeros(0, np.uint64)
        for batch in batches:
            near = []
            for v, x, y in zip(batch.column("v").to_pylist(), texts(batch, "text_u"), texts(batch, "text_v")):
                if v != last:
                    last, b = v, shingle_set(word_hashes(y))
                a = shingle_set(word_hashes(x))
                both = len(np.intersect1d(a, b, assume_unique=True))
                near.append(ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    some = written(pairs, "near_pairs")
    ends = some.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    # One text per node: any of the same words has the same shingles.
    words = docs.select(F.xxhash64("text").alias("th"), "text").join(named.select("node", "th").join(ends, "node"), "th")
    words = written(words.dropDuplicates(["node"]).select("node", "text"), "near_words")
    return _sides(some, words, "text").select("u", "v", "text_u", "text_v").mapInArrow(alike, "u long, v long")


def across(named: DataFrame) -> DataFrame:
    """Rows of named(key, node, root) dealt to pairs of blocks (bi, bj) of their key, so that rows of different roots meet.

    Rows of a key's most frequent root are in blocks of their own, which pair with the
    other blocks only: a key of n rows, m of them of other roots, gives n * m / BLOCK
    rows, not n * n / BLOCK, and a large group whose links are known gives next to none.
    """
    per = named.groupBy("key", "root").agg(F.count("*").alias("c"))
    top = per.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("t")).where("n > t.c")
    split = top.select("key", F.col("t.root").alias("_top"), F.ceil((F.col("n") - F.col("t.c")) / BLOCK).cast("int").alias("_few"), F.ceil(F.col("t.c") / BLOCK).cast("int").alias("_many"))
    x = named.join(split, "key").withColumn("_in", F.col("root") == F.col("_top"))
    spread = F.xxhash64("node")
    x = x.withColumn("blk", F.when(F.col("_in"), F.col("_few") + F.pmod(spread, F.col("_many"))).otherwise(F.pmod(spread, F.col("_few"))).cast("int"))
    x = x.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_few") + F.when(F.col("_in"), 0).otherwise(F.col("_many")) - 1)))
    return x.select("key", "node", "root", F.least("blk", "_o").alias("bi"), F.greatest("blk", "_o").alias("bj"))


def with_root(rows: DataFrame, roots: DataFrame, name: str = "root") -> DataFrame:
    """Rows that have a node, with its root of roots(node, root), or itself."""
    of = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return rows.join(of, F.col("node") == F.col("_n"), "left").withColumn(name, F.coalesce("_r", "node")).drop("_n", "_r")


def apart(dealt: DataFrame, marks: DataFrame, roots: DataFrame, best: bool = False) -> DataFrame:
    """(u, v) of dealt(key, bi, bj, node) that meet there and share enough marks and enough of marks(node, marks, bins, size)'s bins, but not yet a root; with ``best``, of each pair of blocks and pair of roots only the pair that shares most."""
    by = ["key", "bi", "bj"]
    ready = dealt.select(*by, "node").join(with_root(marks, roots), "node").repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, by):
            node, root, size = (t.column(c).to_numpy() for c in ("node", "root", "size"))
            m, ranges = _bytes(t.column("marks")), _bytes(t.column("bins"), BINS)
            ends = at if at[-1] == t.num_rows else np.append(at, t.num_rows)
            for s, e in zip(ends, ends[1:]):
                x, r = m[s:e], root[s:e]
                if e - s <= FEW_ROWS:
                    tally = (x[:, None] == x[None]).sum(axis=2, dtype=np.uint8)
                else:
                    tally = np.zeros((e - s, e - s), dtype=np.uint8)
                    for k in range(x.shape[1]):
                        tally += x[:, k, None] == x[None, :, k]
                i, j = np.nonzero((tally >= LEAST_SAME) & (r[:, None] > r[None, :]))
                differ = np.concatenate([np.zeros(0, np.int64), *((ranges[s + i[k : k + 4096]] != ranges[s + j[k : k + 4096]]).sum(axis=1) for k in range(0, len(i), 4096))])
                near = (ALIKE[0] + ALIKE[1]) * differ <= (ALIKE[1] - ALIKE[0]) * (size[s + i] + size[s + j])
                i, j = i[near], j[near]
                if best and len(i):
                    o = np.lexsort((-tally[i, j].astype(np.int16), r[j], r[i]))
                    i, j = i[o], j[o]
                    lead = np.append(True, (r[i[1:]] != r[i[:-1]]) | (r[j[1:]] != r[j[:-1]]))
                    i, j = i[lead], j[lead]
                yield pa.RecordBatch.from_arrays([pa.array(node[s:e][i]), pa.array(node[s:e][j])], ["u", "v"])

    return ready.mapInArrow(run, "u long, v long").distinct()


def close(lists: DataFrame) -> DataFrame:
    """(u, v) of nodes u that share CLOSE of lists(key, node, v) with a v."""
    return lists.where("node <> v").groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("c")).where(F.col("c") >= CLOSE).select("u", "v")


def renamed(lists: DataFrame, found: DataFrame) -> DataFrame:
    """lists(node, v) as (node, root, v), v being its root in found(node, root)."""
    of = with_root(lists.select(F.col("v").alias("node"), F.col("node").alias("_u")), found, "v")
    return with_root(of.select(F.col("_u").alias("node"), "v"), found).select("node", "root", "v")


def clusters(lists: DataFrame, links: DataFrame, anew: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root) of nodes that share CLOSE of lists(key, node, v) with one least node, or then with those of one cluster, or have a link; nodes of no cluster may be left out.

    ``anew`` gives the lists (node, root, v) for clusters that are found; else their rows are joined to them.
    """
    edges = written(links.unionByName(close(lists)), "close")
    found = joined(edges)
    for _ in range(GATHER - 1):
        of = anew(found) if anew else renamed(lists, found)
        edges = written(edges.unionByName(close(of.where("root <> v"))), "close")
        found = joined(edges)
    return found


def near_components(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, th, root), one row per row of docs; equal roots are joined by links of ALIKE or more.

    Texts without words, null included, are one component.
    """
    small_batches(docs.sparkSession)
    rows = written(sketches(docs), "sketches")
    classes = written(rows.groupBy("node").agg(F.min("th").alias("th"), *(F.first(c).alias(c) for c in ("marks", "sure", "bins", "size"))), "nodes")
    lists = shared(classes)
    # All that follows is about the texts that share a list.
    met = written(classes.join(lists.select("node").distinct(), "node", "left_semi"), "met")
    marks = met.select("node", "marks", "bins", "size")
    least = lists.where("node <> v").groupBy(F.col("node").alias("u"), "v").agg(F.count("*").alias("c"))
    first = least.groupBy("u").agg(F.max(F.struct("c", "v"))["v"].alias("most"), F.min("v").alias("least"))
    first = first.select("u", F.explode(F.array_distinct(F.array("most", "least"))).alias("v"))
    links = written(verified(tallied(first, marks), docs, met), "links")
    # Texts of one cluster meet once, as a cluster; in a list, those of different clusters do. Most lists of a large
    # group of near copies lie in one cluster, so lists are dealt anew with the clusters: joins would take every row of them.
    anew = lambda found: shared(with_root(met, found))
    cluster = clusters(lists, links, anew)
    listed = written(across(anew(cluster).select("key", "node", "root")).select("key", "bi", "bj", "node"), "listed")
    roots = joined(links)
    # Groups mostly join by their best pairs, so that few are left whose every pair is verified.
    for best in (True, False):
        gathered = across(with_root(cluster.select(F.col("root").alias("key"), "node"), roots)).select("key", "bi", "bj", "node")
        links = written(links.unionByName(verified(apart(gathered.unionByName(listed), marks, roots, best), docs, met)), "links")
        roots = joined(links)
    named = rows.select("doc_id", "th", "node").join(roots, "node", "left")
    return named.select("doc_id", "th", F.coalesce("root", "node").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the first by (doc_id, hash of the text); rows without an id are kept.

    Rows that share an id but not a component are documents of their own.
    """
    rows = docs.select(packed(docs).alias("row"), "doc_id", "text")
    known = rows.where("doc_id IS NOT NULL")
    first = near_components(known).groupBy("root").agg(F.min(F.struct("doc_id", "th")).alias("f")).select("f.doc_id", "f.th")
    named = known.select("row", "doc_id", F.xxhash64("text").alias("th")).join(first, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    kept = named.select("row").unionByName(rows.where("doc_id IS NULL").select("row"))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
