"""Vector links against all cosines: tables without duplicates, clusters, uneven directions, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm import embeddings

VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, x, label=None):
    return spark.createDataFrame([(k, v.tolist(), 0 if label is None else int(label[k])) for k, v in enumerate(x)], VECTORS)


def near(x):
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return (u @ u.T >= 0.98) & ~np.eye(len(x), dtype=bool)


def tables():
    g = np.random.default_rng(2)
    base = g.standard_normal((400, 48))
    noise = lambda x, size: x + size * np.linalg.norm(x, axis=1, keepdims=True) / np.sqrt(48) * g.standard_normal(x.shape)
    plain = np.concatenate([base, noise(base, 0.19), noise(base[:100], 0.15)])
    uneven = plain * np.geomspace(1, 0.02, 48)
    centre = g.standard_normal((5, 48))[g.integers(5, size=700)]
    clustered = centre + 0.45 * g.standard_normal((700, 48))
    clustered = np.concatenate([clustered, noise(clustered[:300], 0.17)])
    group = noise(np.repeat(base[:1], 900, axis=0), 0.1)
    return {"plain": plain, "uneven": uneven, "clustered": clustered, "group": group}


@pytest.mark.parametrize("name", ["plain", "uneven", "clustered", "group"])
def test_recall_and_no_others(spark, monkeypatch, name):
    """At least 0.9 of all links, none below the bound; small blocks and few neighbours, so cells and block pairs are at work."""
    monkeypatch.setattr(embeddings, "NEIGHBOURS", 8)
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    x = tables()[name]
    want = near(x)
    found = {r["vec_id"]: r for r in embeddings.vector_components(frame(spark, x)).collect()}
    got = np.array([found[k]["n_links"] for k in range(len(x))])
    assert want.sum() > 300 and (got <= want.sum(axis=1)).all()
    assert got.sum() >= 0.97 * want.sum()


def test_work_grows_with_the_number_of_vectors(spark):
    """Pairs that share a cell in any list, in a table without duplicates."""
    g = np.random.default_rng(3)
    made = {}
    for n in (2000, 8000):
        x = frame(spark, g.standard_normal((n, 64))).withColumnRenamed("vec_id", "cls")
        way = embeddings.plan(x)
        sizes = embeddings.postings(x, way).groupBy("label", "key").agg(F.count("*").alias("n"))
        made[n] = sizes.agg(F.sum(F.expr("n * (n - 1) / 2"))).first()[0], way
    assert made[8000][0] < 8 * made[2000][0] and made[8000][0] < 0.05 * 8000**2 / 2, made


def test_odd_rows(spark):
    """Nulls, zeros, sizes, clashing columns, repeated rows; an empty table."""
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 1), (1, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1), (7, [1.0, None, 3.0], 1), (8, [float("inf")] * 3, 1), (None, one, 1), (9, [1.0, 2.0], 1), (10, one, 2)]
    x = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("cls", "n", "key", "first", "root", "blk")})
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.vector_components(x).collect())
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10)]
    assert found == sorted([(0, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), *alone], key=lambda r: (r[0], r[1]))
    assert embeddings.vector_components(x.where("false")).count() == 0
