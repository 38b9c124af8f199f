"""The ranking against plain Newton steps on every pair of labelled rows."""

import numpy as np
from quern.llm import quality
from quern.llm.quality import FEATURES, RIDGE


def by_force(better, worse):
    d = (better[:, None, :] - worse[None, :, :]).reshape(-1, FEATURES)
    w = np.zeros(FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(d @ w)))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(FEATURES), d.T @ (1 - p) / len(d) - RIDGE * w)
    return w


def test_all_pairs_and_exact_cut(spark, monkeypatch):
    g = np.random.default_rng(8)
    label = (np.arange(400) % 5 > 0).astype(int)
    x = g.normal(size=(400, FEATURES)) + 0.4 * label[:, None] * (np.arange(FEATURES) % 3)
    x[:, 0] = 1.0
    rows = spark.createDataFrame([(int(v), f.tolist()) for v, f in zip(label, x)], "label int, f array<double>").repartition(3)
    z = (x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9)
    w = by_force(z[label == 1], z[label == 0])
    for near in (quality.NEAR_CUT, 3):
        monkeypatch.setattr(quality, "NEAR_CUT", near)
        found = quality.Ranker(rows)
        assert np.abs(found.w - w).max() < 5e-4 * np.abs(w).max()
        raw = np.sort(z @ found.w)
        assert abs(found.cut - raw[79:81].mean()) < 1e-9 and abs(found.scale - raw.std()) < 1e-9
    assert not hasattr(quality, "SAMPLE_ROWS")


def test_ranks_of_repeated_scores(spark, monkeypatch):
    monkeypatch.setattr(quality, "NEAR_CUT", 2)
    values = [0.0] * 50 + [1.0, 2.0, 2.0, 7.5]
    raw = spark.createDataFrame([(v,) for v in values], "raw double")
    assert all(quality.ranked(raw, k) == values[k : k + 2] for k in (0, 48, 49, 50, 51, 52, 53))
