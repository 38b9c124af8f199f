"""Near-duplicate vectors by counting collisions of sorted one-dimensional projections.

Every list sorts the vectors of a label by one random projection inside the cells of
some more, and a query collides with what stands in its window there: as far to
either side as a pair at the similarity bound seldom exceeds. Beside its place in a
list a vector carries COUNTED short projections, and a pair that meets in a list is
kept if it collides in LEAST of them, a count that a pair at the bound misses with
chance below 1e-4. Only ids and projections are shuffled for that. Vectors that kept
a partner are then brought together once more, by list and cell, and their cosines
are worked out in double precision.

How many projections make a cell is measured on the whole table: the fewest that
leave a vector NEIGHBOURS others in its cells; the number of lists follows from that
and RECALL. So work grows with the number of vectors, not with its square, however
many there are, unless a table is dense at the bound itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.llm.common import groups, in_blocks, local_roots, table, written
from quern.llm.components import components

THRESHOLD = 0.98
#: Projections are in units of what a pair at the bound differs by, on average, in a direction.
WINDOW, CELL = 2.5, 10.0
COUNTED, LEAST = 16, 13
#: Least chance that a pair at the bound meets in some list, over the choice of directions.
RECALL = 0.995
NEIGHBOURS = 32
#: Numbers of projections that a cell may have.
DEPTHS = tuple(range(0, 33, 2))
BLOCK = 128
#: Pairs that are looked at together.
CHUNK = 1 << 20
SEED = 7


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def meeting_chance(depth: int) -> float:
    """That a pair at the bound shares a cell of ``depth`` projections and a window."""
    cell = erf(CELL / sqrt(2)) - 2 / (sqrt(2 * pi) * CELL) * (1 - exp(-CELL * CELL / 2))
    return cell**depth * erf(WINDOW / sqrt(2))


@dataclass(frozen=True)
class Plan:
    """Lists and the projections of their cells."""

    depth: int
    lists: int
    threshold: float = THRESHOLD

    def directions(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit columns: depth + 1 for each list and COUNTED more, scaled to the units of windows; and where the cells of each start."""
        n = self.lists * (self.depth + 1) + COUNTED
        g = np.random.default_rng((SEED, dim))
        d = g.standard_normal((dim, n))
        return d / np.linalg.norm(d, axis=0) * sqrt(dim / max(2 - 2 * self.threshold, 1e-12)), g.random(n)

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of unit vectors: the cell and the place in each list, and the short projections.

        Sums go dimension by dimension, so a vector has the same places whatever stands beside it.
        """
        d, offset = self.directions(x.shape[1])
        p = np.zeros((len(x), d.shape[1]))
        for j in range(x.shape[1]):
            p += x[:, j, None] * d[j]
        step = self.depth + 1
        key = np.empty((len(x), self.lists), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.lists):
                at = slice(k * step, k * step + self.depth)
                cells = np.floor(p[:, at] / CELL + offset[at]).astype(np.int64).view(np.uint64)
                h = np.full(len(x), (x.shape[1] << 16) + k, dtype=np.uint64)
                for c in cells.T:
                    h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + c)
                key[:, k] = _mixed(h)
        short = np.clip(np.round(4 * p[:, self.lists * step :]), -127, 127).astype(np.int8)
        return key.view(np.int64), p[:, self.depth : self.lists * step : step], short


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Windows of short projections that each pair shares, give or take their rounding."""
    return (np.abs(a.astype(np.int16) - b) <= int(4 * WINDOW) + 1).sum(axis=-1)


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    squares = np.zeros(len(x))
    for j in range(x.shape[1]):
        squares += x[:, j] * x[:, j]
    return x / np.sqrt(squares)[:, None]


def by_size(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each number of dimensions."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, unit(values[start[at, None] + np.arange(dim)])


def _joined(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def neighbours(classes: DataFrame, threshold: float = THRESHOLD) -> dict[int, float]:
    """How many vectors share a vector's cell, on average, by the projections of a cell; one row for each of DEPTHS comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_size(batch.column("embedding")):
                for depth in DEPTHS:
                    key, *_ = Plan(depth, 1, threshold).places(x)
                    yield pa.RecordBatch.from_arrays([batch.column("label").take(pa.array(at)), pa.array(np.full(len(at), depth, np.int32)), pa.array(key[:, 0])], ["label", "depth", "key"])

    kind = classes.schema["label"].dataType.simpleString()
    cells = classes.select("label", "embedding").mapInArrow(run, f"label {kind}, depth int, key long").groupBy("label", "depth", "key").agg(F.count("*").cast("double").alias("n"))
    return {r["depth"]: r["s"] / r["n"] for r in cells.groupBy("depth").agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()}


def plan(classes: DataFrame, threshold: float = THRESHOLD) -> Plan:
    found = neighbours(classes, threshold)
    depth = next((d for d in DEPTHS if found.get(d, 0) <= NEIGHBOURS), DEPTHS[-1])
    p = meeting_chance(depth)
    return Plan(depth, max(1, ceil(log(1 - RECALL) / log(1 - p))), threshold)


def postings(classes: DataFrame, way: Plan) -> DataFrame:
    """classes(cls, label, embedding) to (label, key, cls, x, s0, s1), one row per list."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_size(batch.column("embedding")):
                key, place, short = way.places(x)
                s = short.view(np.int64)
                label, cls = batch.column("label").take(pa.array(at)), batch.column("cls").take(pa.array(at))
                for k in range(way.lists):
                    yield pa.RecordBatch.from_arrays([label, pa.array(key[:, k]), cls, pa.array(place[:, k].astype(np.float32)), pa.array(s[:, 0]), pa.array(s[:, 1])], ["label", "key", "cls", "x", "s0", "s1"])

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("cls", "label", "embedding").mapInArrow(run, f"label {kind}, key long, cls long, x float, s0 long, s1 long")


def windows(group: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group that stand in each other's window, some at a time."""
    order = np.lexsort((x, group))
    wide = WINDOW + 1e-3
    line = group[order] * (float(x.max() - x.min()) + 4 * wide) + (x[order] - x.min())
    end = np.searchsorted(line, line + wide, side="right")
    many = end - np.arange(len(x)) - 1
    before = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + CHUNK, side="right")) - 1)
        n = many[lo:hi]
        i = np.repeat(np.arange(lo, hi), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(before[lo:hi] - before[lo], n)
        if len(i):
            yield order[i], order[j]
        lo = hi


KEYS = ["label", "key", "bi", "bj"]


def partnered(posted: DataFrame) -> DataFrame:
    """(label, key, bi, bj, blk, cls) of the postings that collide with another in their list, and LEAST times in all."""
    kind = posted.schema["label"].dataType.simpleString()
    dealt = in_blocks(posted, ["label", "key"], F.xxhash64("cls"), BLOCK)
    ready = dealt.select(*KEYS, "blk", "cls", "x", "s0", "s1").repartition(*KEYS).sortWithinPartitions(*KEYS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, KEYS):
            ends = at[1:] if at[-1] == t.num_rows else np.append(at[1:], t.num_rows)
            group = np.repeat(np.arange(len(ends)), ends - at[: len(ends)])
            bi, bj, blk = (t.column(c).to_numpy() for c in ("bi", "bj", "blk"))
            short = np.column_stack([t.column(c).to_numpy() for c in ("s0", "s1")]).view(np.int8)
            kept = np.zeros(t.num_rows, dtype=bool)
            for i, j in windows(group, t.column("x").to_numpy().astype(np.float64)):
                apart = (bi[i] == bj[i]) | (blk[i] != blk[j])
                i, j = i[apart], j[apart]
                near = collisions(short[i], short[j]) >= LEAST
                kept[i[near]] = kept[j[near]] = True
            if kept.any():
                yield from t.select([*KEYS, "blk", "cls"]).filter(pa.array(kept)).to_batches()

    return ready.mapInArrow(run, f"label {kind}, key long, bi int, bj int, blk int, cls long")


def class_links(classes: DataFrame, way: Plan) -> DataFrame:
    """classes(cls, n, label, embedding) to rows (u, v, links): v is joined to u, links counts rows that u links with in this pair of blocks.

    A pair that meets in several lists counts in the first of them.
    """
    some = written(partnered(postings(classes, way)), "partnered")
    ready = some.join(classes.select("cls", "n", "embedding"), "cls").repartition(*KEYS).sortWithinPartitions(*KEYS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, KEYS):
            col = {c: t.column(c).to_numpy() for c in ("key", "blk", "bi", "bj", "cls", "n")}
            vectors = _joined(t.column("embedding"))
            out = [], [], []
            ends = at[1:] if at[-1] == t.num_rows else np.append(at[1:], t.num_rows)
            for s, e in zip(at, ends):
                for rows, x in by_size(vectors.slice(s, e - s)):
                    if len(rows) < 2:
                        continue
                    blk, n, cls = (col[c][s:e][rows] for c in ("blk", "n", "cls"))
                    key, place, short = way.places(x)
                    near = collisions(short[:, None], short[None]) >= LEAST
                    near &= (blk[:, None] != blk[None]) if col["bi"][s] != col["bj"][s] else ~np.eye(len(rows), dtype=bool)
                    a, b = np.nonzero(near)
                    meet = (key[a] == key[b]) & (np.abs(place[a] - place[b]) <= WINDOW)
                    first = np.argmax(meet, axis=1)
                    here = meet[np.arange(len(a)), first] & (key[a, first] == col["key"][s])
                    a, b = a[here], b[here]
                    near = np.zeros(near.shape, dtype=bool)
                    near[a, b] = np.einsum("ij,ij->i", x[a], x[b]) >= way.threshold
                    root, used = local_roots(near), near.any(axis=1)
                    out[0].append(cls[used])
                    out[1].append(cls[root[used]])
                    out[2].append((near @ n)[used])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["u", "v", "links"])

    return ready.mapInArrow(run, "u long, v long, links long")


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors(vec_id, embedding, label) to (vec_id, n_links, component_id, kept), one row per vector.

    A null label, vector or vec_id, a zero vector and one with null or
    non-finite components link with nothing: n_links 0, component_id their own
    id. Vectors of different sizes link with nothing of another size. Equal vectors of a label are one node with a count,
    found by their values, so copies and repeated rows make no pairs. Other columns are left out. An empty table gives no rows.
    """
    e = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = ~F.exists(e, bad) & F.exists(e, lambda x: x != 0)
    ok = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole, F.lit(False))
    x = vectors.select("vec_id", "embedding", "label", ok.alias("ok"))
    same = x.where("ok").groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    # Ids hold because the rows are written with them.
    classes = written(same.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    found = written(class_links(classes.select("cls", "n", "label", "embedding"), plan(classes, threshold)), "links")
    links = found.groupBy(F.col("u").alias("cls")).agg(F.sum("links").alias("links"))
    roots = components(found.select("u", "v"))
    named = classes.select("cls", "n", "first").join(links, "cls", "left").join(roots, classes["cls"] == roots["node"], "left")
    named = written(named.select("cls", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("cls", "n_links", "component_id").join(classes.select("cls", "label", "embedding"), "cls")
    out = x.where("ok").join(of, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = x.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_embeddings(spark, folder: str) -> DataFrame:
    return vector_components(table(spark, folder, "embeddings"))


OP7_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, label, e FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id AS u, vec_id AS v FROM v UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
root AS (SELECT u AS vec_id, min(v) AS component_id FROM reach GROUP BY u), n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN root USING (vec_id) LEFT JOIN n USING (vec_id)
"""
