"""Toxicity by a classifier chain of linear models over hashed word features.

Only ``toxic`` is labelled, so the earlier categories of the chain are learned
aspects of it: the strong toxic features of the training rows are dealt in turn, by falling
support, to ASPECTS groups, and each aspect asks whether a toxic
document has a feature of its group. Every link is a logistic regression that also
sees the probabilities of the links before it; in training those come from
models that did not see the row (out-of-fold), features and groups included, in scoring from the full models.

Null and empty texts have no features and score the prior of such rows; an empty table gives no rows, one without labels scores of zero.
Rows that repeat score alike; a document labelled both ways counts once for each; equal texts share a fold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.llm.common import crc_mod, packed, small_batches, table, texts
from quern.llm.quality import admitted_labels, labelled_sample

#: Rows of either label that the fit may use.
SAMPLE_ROWS = 4000
FOLDS = 4
ASPECTS = 2
RIDGE = 1e-4
STEPS = 60
THRESHOLD = 0.5
#: Lengths of the word beginnings that are features beside whole words.
PREFIXES = (4, 5, 6)
#: A feature is evidence if the lower confidence bound of its log-odds reaches STRONG and SUPPORT documents have it.
STRONG, SUPPORT, DEVIATIONS = 1.5, 3, 1.5
_STRIP = b".,;:!?\"'()[]{}"
_CACHE: dict[bytes, tuple[int, ...]] = {}


def word_slots(word: bytes) -> tuple[int, ...]:
    """Hashed features of a word: itself and its beginnings; a bounded memo spares most hashing."""
    found = _CACHE.get(word)
    if found is None:
        if len(_CACHE) > 200_000:
            _CACHE.clear()
        w = word.strip(_STRIP).decode("utf-8", "replace")
        parts = [f"={w}", *(w[:n] for n in PREFIXES if len(w) >= n)] if w else []
        found = _CACHE[word] = tuple(xxhash.xxh32_intdigest(x, 1) >> 1 for x in parts)
    return found


def slots(text: bytes) -> np.ndarray:
    """Distinct hashed features of a text, A-Z in lower case."""
    found: set[int] = set()
    for w in set(text.lower().split()):
        found.update(word_slots(w))
    return np.sort(np.fromiter(found, dtype=np.int32, count=len(found)))


def evidence(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, lower bound of its log-odds, documents of label 1 with it) of the strong features, by feature."""
    sides = [np.concatenate([np.zeros(0, np.int32), *(d for d, label in zip(docs, y) if label == v)]) for v in (0, 1)]
    n = [max(1, int((y == v).sum())) for v in (0, 1)]
    f, has = np.unique(sides[1], return_counts=True)
    f, has = f[has >= SUPPORT], has[has >= SUPPORT]
    g, other = np.unique(sides[0], return_counts=True)
    at = np.minimum(np.searchsorted(g, f), max(len(g) - 1, 0))
    miss = np.where(g[at] == f, other[at], 0) if len(g) else np.zeros(len(f))
    odds = np.log((has + 0.5) / (n[1] + 1)) - np.log((miss + 0.5) / (n[0] + 1))
    low = odds - DEVIATIONS * np.sqrt(1 / (has + 0.5) + 1 / (miss + 0.5) * (miss > 0))
    return f[low >= STRONG], low[low >= STRONG], has[low >= STRONG]


class Linear:
    """Logistic regression on summaries of a document's strong features, and extra dense columns.

    The summaries (largest log-odds, sum, count) weigh a toxic word the same in a long text as in a short one.
    """

    def __init__(self, docs: list[np.ndarray], y: np.ndarray, extra: np.ndarray, weight: np.ndarray):
        self.features, self.odds, _ = evidence(docs, y)
        x = np.column_stack([self.summaries(docs), extra])
        self.mean, self.std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.std])
        self.w = np.zeros(z.shape[1])
        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            grad = z.T @ (weight * (y - p)) / weight.sum() - RIDGE * self.w
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z / weight.sum() + RIDGE * np.eye(len(self.w))
            step = np.linalg.solve(hess, grad)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def summaries(self, docs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(docs), 3))
        if not len(self.features):
            return out
        for r, d in enumerate(docs):
            at = np.minimum(np.searchsorted(self.features, d), len(self.features) - 1)
            o = self.odds[at[self.features[at] == d]]
            if len(o):
                out[r] = o.max(), np.log1p(o.sum()), np.log1p(len(o))
        return out

    def predict(self, docs: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        x = (np.column_stack([self.summaries(docs), extra]) - self.mean) / self.std
        return 1 / (1 + np.exp(-np.clip(self.w[0] + x @ self.w[1:], -30, 30)))


def aspects(docs: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Labels of each aspect: toxic documents with a strong feature of its group; features are dealt by falling support."""
    f, _, has = evidence(docs, y)
    order = np.argsort(-has, kind="stable")
    groups = [np.sort(f[order[k::ASPECTS]]) for k in range(ASPECTS)]
    return [np.array([label == 1 and bool(np.isin(d, g).any()) for d, label in zip(docs, y)], dtype=float) for g in groups]


class Chain:
    """Links in order: the aspects, then toxic itself. ``weight`` is how many labelled rows each row stands for."""

    def __init__(self, docs: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, weight: np.ndarray):
        self.links: list[Linear] = []
        seen = np.zeros((len(docs), 0))
        parts = [(np.flatnonzero(fold == f), np.flatnonzero(fold != f)) for f in range(FOLDS)] if len(docs) else []
        parts = [(held, rest, [docs[i] for i in rest]) for held, rest in parts if len(held)]
        folded = [self.targets(some, toxic[rest]) for _, rest, some in parts]
        for k, y in enumerate(self.targets(docs, toxic) if len(docs) else []):
            out = np.full(len(docs), np.average(y, weights=weight))
            for (held, rest, some), targets in zip(parts, folded):
                if len(np.unique(targets[k])) == 2:
                    out[held] = Linear(some, targets[k], seen[rest], weight[rest]).predict([docs[i] for i in held], seen[held])
            self.links.append(Linear(docs, y, seen, weight))
            seen = np.column_stack([seen, out])
        self.folded = seen

    @staticmethod
    def targets(docs: list[np.ndarray], toxic: np.ndarray) -> list[np.ndarray]:
        return [*aspects(docs, toxic), toxic.astype(float)]

    def predict(self, docs: list[np.ndarray]) -> np.ndarray:
        """One column per link; without training rows, one of zeros."""
        seen = np.zeros((len(docs), 0))
        for link in self.links:
            seen = np.column_stack([seen, link.predict(docs, seen)])
        return seen if self.links else np.zeros((len(docs), ASPECTS + 1))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fitted on at most 2 * sample_rows labelled rows whose crc32(doc_id) mod 4 is not 2; only their hashed words come to the driver.

    A row weighs the inverse of its label's share in the sample, so the prior is that of all admitted labels at every size.
    """
    small_batches(docs.sparkSession)
    train = crc_mod("doc_id", 4) != 2
    known = labelled_sample(docs, labels, "toxic", sample_rows, train)
    stands = np.ones(2)
    for r in admitted_labels(labels, "toxic", train).groupBy("label").agg(F.count("*").alias("n")).collect():
        stands[r["label"]] = max(1.0, r["n"] / sample_rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([slots(t) for t in texts(batch)], pa.list_(pa.int32()))], ["label", "words"])

    rows = known.mapInArrow(run, "label int, words array<int>").toArrow().combine_chunks()
    lists = pa.concat_arrays(rows.column("words").chunks) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    words = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]) if len(lists) else []
    label = rows.column("label").to_numpy()
    key = [xxhash.xxh64_intdigest(w.tobytes(), 5) for w in words]
    order = np.argsort(np.array(key, dtype=np.uint64), kind="stable") if key else np.zeros(0, dtype=np.int64)
    # Equal texts share a fold, so no copy predicts its twin.
    fold = np.array([key[i] % FOLDS for i in order], dtype=np.int64)
    return Chain([words[i] for i in order], label[order], fold, stands[label[order]])


def score_toxicity(docs: DataFrame, chain: Chain, columns: list[str] | None = None) -> DataFrame:
    """The given columns (doc_id if none) with aspect_1.. and score. Null texts count as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    keep = columns or ["doc_id"]
    names = [*(f"_aspect_{k + 1}" for k in range(ASPECTS)), "_score"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = shared.value.predict([slots(t) for t in texts(batch)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(p[:, k].astype(np.float64)) for k in range(len(names)))], [*keep, *names])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema + "".join(f", {n} double" for n in names))


def remove_toxic(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None) -> DataFrame:
    """docs without those scored toxic; rows keep their columns, of any name."""
    chain = fit_toxicity(docs if train_docs is None else train_docs, labels)
    rows = docs.select(packed(docs).alias("row"), "text")
    return score_toxicity(rows, chain, ["row"]).where(F.col("_score") < THRESHOLD).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_toxicity(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = score_toxicity(docs, fit_toxicity(docs, table(spark, folder, "labels")))
    score = F.col("_score")
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), *(F.col(f"_aspect_{k + 1}").alias(f"aspect_{k + 1}") for k in range(ASPECTS)), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), (score >= THRESHOLD).alias("toxic"))
