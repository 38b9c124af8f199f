"""SimHash near-duplicates through an inverted index of fingerprint bytes.

Two 64-bit fingerprints that differ in at most three bits share at least five of
their eight positional bytes, and so at least three of the four bytes of one
half. The index therefore posts each fingerprint under eight keys: each three
positions out of a half, with their bytes. Inside a posting list, shared
positional bytes are tallied per pair, pairs of five or more are retained, and
the differing bits of those are counted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.llm.common import groups, in_blocks, local_roots, small_batches, texts, written
from quern.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
BLOCK = 256
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a text; zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)))]
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64, count=len(grams))
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp); null text counts as empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(x) for x in texts(batch)], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal positional bytes of each pair of two arrays of fingerprints."""
    x, y = (v.view(np.uint8).reshape(-1, 8) for v in (a, b))
    tally = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(8):
        tally += x[:, k, None] == y[None, :, k]
    return tally


def linked(fps: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    near = shared_bytes(fps, fps) >= MIN_BYTES
    i, j = np.nonzero(near)
    near[i, j] = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
    return near


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """distinct(fp) to edges(u, v) that join what links join: a spanning forest of each pair of blocks."""
    byte = lambda k: F.shiftrightunsigned("fp", 8 * k).bitwiseAND(255)
    key = lambda i, t: F.lit(i << 24) + F.shiftleft(byte(t[0]), 16) + F.shiftleft(byte(t[1]), 8) + byte(t[2])
    posted = distinct.select("fp", F.explode(F.array(*(key(i, t) for i, t in enumerate(TRIPLES)))).alias("key"))
    dealt = in_blocks(posted, ["key"], F.xxhash64("fp"), BLOCK)
    keys = ["key", "bi", "bj"]
    ready = dealt.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in groups(batches, keys):
            fp = t.column("fp").to_numpy()
            size = np.diff(np.append(at, len(fp))) if at[-1] != len(fp) else np.diff(at)
            at = at[: len(size)]
            two = at[size == 2]
            a, b = fp[two], fp[two + 1]
            # Lists of two are tallied together.
            near = (a.view(np.uint8).reshape(-1, 8) == b.view(np.uint8).reshape(-1, 8)).sum(axis=1) >= MIN_BYTES
            near[near] = np.bitwise_count(a[near] ^ b[near]) <= MAX_BITS
            u, v = [a[near]], [b[near]]
            for s, n in zip(at[size > 2], size[size > 2]):
                part = fp[s : s + n]
                root = local_roots(linked(part))
                moved = root != np.arange(n)
                u.append(part[moved])
                v.append(part[root[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return ready.mapInArrow(run, "u long, v long").distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, fp, component_id), one row per row of docs.

    component_id is the smallest doc_id reachable over links; null ids never name
    a component. Equal fingerprints are one node, so copies cost no pairs. Empty
    and null texts have fingerprint zero and link as any other. An empty table
    gives no rows.
    """
    rows = written(fingerprints(docs), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(classes.select("fp")))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named, "classes")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = named.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp")


def op1_simhash(spark, folder: str) -> DataFrame:
    from quern.llm.common import table

    found = simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
