"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of all preference pairs.

Every labelled row of label 1 is preferred to every one of label 0. The loss of all these
pairs needs no pair: it follows from sums over rows at scores WIDTH apart, between which
a row is shared in proportion, so a pair's chance is read off to within 3e-5. The cut is a quantile of all training
rows' scores: as many of the labelled documents fall below it as have label 0.
Null and empty texts have the features of no words; rows that repeat score alike; a document labelled both ways counts once for each;
an empty table gives no rows, one without labels of both kinds the same score for all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.llm.common import crc_mod, small_batches, table, texts, written

#: Of scores that are summed; scores beyond REACH count as REACH, where a pair's chance is 0 or 1 in any case.
WIDTH, REACH = 1 / 32, 32
#: Scores that come to the driver to find the quantile among.
NEAR_CUT = 50_000
RIDGE = 1e-3
#: A document counts as good from this score on.
GOOD = 0.7
FEATURES = 16


def features(text: bytes) -> np.ndarray:
    """Shape of a text: character classes, word lengths, repetition, lines; all zero for no words."""
    out = np.zeros(FEATURES)
    w = text.split()
    if not w:
        return out
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n, k = len(text), len(w)
    digits, upper, lower = count[48:58].sum(), count[65:91].sum(), count[97:123].sum()
    space, high = count[32] + count[9:14].sum(), count[128:].sum()
    marks = n - digits - upper - lower - space - high
    plain = count[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    same = sum(a == b for a, b in zip(w, w[1:]))
    lines = text.split(b"\n")
    filled = [x for x in lines if x.strip()]
    out[:] = (
        1.0, marks / n, (marks - plain) / n, digits / n, upper / max(1, upper + lower), space / n, high / n, len(set(w)) / k, same / k,
        min(20.0, n / k) / 20, np.log1p(k) / 10, len(filled) / k, 1 - len(set(filled)) / max(1, len(filled)), sum(len(x) == 1 for x in w) / k,
        max(count[[35, 36, 37, 38, 42, 124]]) / k, count[33] / k,
    )
    return out


def summed(rows: DataFrame, make, width: int) -> dict[int, np.ndarray]:
    """Sums over rows(label, f) of what make(labels, features) gives for a batch: integer keys and one row of ``width`` numbers for each."""
    names = [f"v{k}" for k in range(width)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                key, value = make(batch.column("label").to_numpy(), matrix(batch.column("f")))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *(pa.array(value[:, k], pa.float64()) for k in range(width))], ["key", *names])

    parts = rows.select("label", "f").mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in names))
    found = parts.groupBy("key").agg(*(F.sum(c).alias(c) for c in names)).collect()
    return {r["key"]: np.array(r[1:], dtype=np.float64) for r in found}


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)


def between(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each score below it, in widths, and its share of the next place."""
    x = np.clip(raw, -REACH, REACH) / WIDTH
    low = np.floor(x)
    return low.astype(np.int64), x - low


def totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[at], np.add.reduceat(values[order], at, axis=0)


def fit_pairs(rows: DataFrame, mean: np.ndarray, std: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights w that maximise the mean likelihood of all pairs of a row a of label 1 and b of label 0, sigmoid(w (a - b)), by Newton steps."""
    w = np.zeros(FEATURES)
    shift = 4 * int(REACH / WIDTH)

    for _ in range(25):

        def placed(label, x, w=w):
            z = (x - mean) / std
            low, share = between(z @ w)
            one = np.column_stack([np.ones(len(z)), z])
            return totals(np.concatenate([low, low + 1]) + shift * np.tile(label, 2), np.concatenate([one * (1 - share)[:, None], one * share[:, None]]))

        found = summed(rows, placed, FEATURES + 1)
        sides = []
        for v in (1, 0):
            keys = sorted(k for k in found if (k > shift // 2) == bool(v))
            x = np.array([found[k] for k in keys]).reshape(-1, FEATURES + 1)
            sides.append((np.array(keys, dtype=np.int64) - shift * v, x[:, 0], x[:, 1:]))
        (k, n, a), (m, o, b) = sides
        if not len(k) or not len(m):
            break
        p = 1 / (1 + np.exp(-WIDTH * (k[:, None] - m[None, :])))
        pairs, spread = n.sum() * o.sum(), p * (1 - p)
        grad = (a.T @ ((1 - p) @ o) - b.T @ ((1 - p).T @ n)) / pairs - ridge * w
        weight = {int(x) + shift: c for x, c in zip(k, spread @ o)} | {int(x): c for x, c in zip(m, spread.T @ n)}

        def squares(label, x, w=w, weight=weight):
            z = (x - mean) / std
            low, share = between(z @ w)
            here, after = (np.array([weight[v] for v in (low + k + shift * label).tolist()]) for k in (0, 1))
            c = (1 - share) * here + share * after
            return np.arange(FEATURES), (z * c[:, None]).T @ z

        outer = summed(rows, squares, FEATURES)
        cross = a.T @ spread @ b
        hess = (np.array([outer[x] for x in range(FEATURES)]) - cross - cross.T) / pairs + ridge * np.eye(FEATURES)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def ranked(raw: DataFrame, low: int) -> list[float]:
    """Of raw(raw) the values of rank ``low`` and the next, from 0; fewer where there are none."""
    while True:
        first, last, n = raw.agg(F.min("raw"), F.max("raw"), F.count("*")).first()
        if n <= NEAR_CUT or first == last:
            break
        at = F.floor((F.col("raw") - first) / (last - first) * 4096)
        parts = raw.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("raw").alias("a"), F.max("raw").alias("b")).orderBy("at").collect()
        ends = np.cumsum([r["n"] for r in parts])
        i, j = (min(int(np.searchsorted(ends, k, side="right")), len(parts) - 1) for k in (low, low + 1))
        if (parts[i]["a"], parts[j]["b"]) == (first, last):
            break
        low -= int(ends[i - 1]) if i else 0
        raw = raw.where((F.col("raw") >= parts[i]["a"]) & (F.col("raw") <= parts[j]["b"]))
    out, before = [], 0
    for r in raw.groupBy("raw").agg(F.count("*").alias("n")).orderBy("raw").collect():
        out += [r["raw"]] * sum(before <= k < before + r["n"] for k in (low, low + 1))
        before += r["n"]
    return out


class Ranker:
    """Standardised features, Bradley-Terry weights, and the raw score at which GOOD lies; fitted on all of rows(label, f)."""

    def __init__(self, rows: DataFrame):
        size = summed(rows, lambda label, x: totals(label.astype(np.int64), np.column_stack([np.ones(len(x)), x])), FEATURES + 1)
        n = sum(v[0] for v in size.values())
        self.mean, self.std, self.w, self.cut, self.scale = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0, 1.0
        if not n:
            return
        mean = self.mean = sum(v[1:] for v in size.values()) / n
        squares = summed(rows, lambda label, x: (np.zeros(1), ((x - mean) ** 2).sum(axis=0)[None, :]), FEATURES)
        self.std = np.maximum(np.sqrt(squares[0] / n), 1e-9)
        self.w = fit_pairs(rows, self.mean, self.std)
        raw = written(scored(rows, [], self.raw, "raw"), "raw")
        # Halfway between the last score below and the first above.
        self.cut = float(np.mean(ranked(raw, max(int(size[0][0]) - 1 if 0 in size else 0, 0))))
        self.scale = max(float(raw.agg(F.stddev_pop("raw")).first()[0]), 1e-9)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.std) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.raw(x) - self.cut) / self.scale * 4 + np.log(GOOD / (1 - GOOD)), -30, 30)))


def admitted_labels(labels: DataFrame, name: str, train) -> DataFrame:
    """(doc_id, label) of the 0/1 labels that ``train`` admits."""
    return labels.where(F.col(name).isin(0, 1) & F.col("doc_id").isNotNull() & train).select("doc_id", F.col(name).alias("label")).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, name: str, rows: int, train) -> DataFrame:
    """(text, label) of at most ``rows`` rows per value of a 0/1 label, the first by hash of doc_id among those that ``train`` admits."""
    known = admitted_labels(labels, name, train)
    parts = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for v in (0, 1)]
    # At most twice ``rows`` rows of two numbers.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    return docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "label")


def featurised(frame: DataFrame, keep: list[str], make, size: int) -> DataFrame:
    """keep columns and ``f``, the features of ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [make(t) for t in texts(batch)]
            flat = pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64())
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * size, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), f], [*keep, "f"])

    schema = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.select(*keep, "text").mapInArrow(run, f"{schema}, f array<double>")


def scored(frame: DataFrame, keep: list[str], make, name: str) -> DataFrame:
    """keep columns and ``name``, what make gives for the features ``f``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(make(matrix(batch.column("f"))), pa.float64())], [*keep, name])

    schema = [f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep]
    return frame.select(*keep, "f").mapInArrow(run, ", ".join([*schema, f"{name} double"]))


def fit_features(found: DataFrame, labels: DataFrame) -> Ranker:
    """Fitted on every row of found(doc_id, f) with an admitted label; sums and the scores next to the cut come to the driver."""
    known = admitted_labels(labels, "quality", crc_mod("doc_id", 4) != 2)
    return Ranker(written(found.join(known, "doc_id").select("label", "f"), "labelled"))


def fit_quality(docs: DataFrame, labels: DataFrame) -> Ranker:
    small_batches(docs.sparkSession)
    return fit_features(featurised(docs, ["doc_id"], features, FEATURES), labels)


def score_quality(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score). Null texts count as empty and score as such."""
    small_batches(docs.sparkSession)
    return scored(featurised(docs, ["doc_id"], features, FEATURES), ["doc_id"], ranker.score, "score")


def op2_quality(spark, folder: str) -> DataFrame:
    small_batches(spark)
    # Texts are read once; their features, 128 bytes a row, serve the fit and the scores.
    rows = written(featurised(table(spark, folder, "documents"), ["doc_id"], features, FEATURES), "features")
    found = scored(rows, ["doc_id"], fit_features(rows, table(spark, folder, "labels")).score, "score")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
