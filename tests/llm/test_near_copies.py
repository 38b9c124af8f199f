"""The near-duplicate stage against plain Jaccard of five-word shingles."""

import corpus_pipeline
import numpy as np
from quern.llm import near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return x == y or len(x & y) >= 0.8 * len(x | y)


def copies():
    """Bases of 200 words, and copies with some words changed: similarities from 0.6 to 0.98."""
    g = np.random.default_rng(5)
    out = []
    for _ in range(12):
        base = [f"w{k}" for k in g.integers(0, 5000, 200)]
        out.append(" ".join(base))
        for changed in (1, 3, 4, 5, 9):
            w = list(base)
            for p in g.choice(200, changed, replace=False):
                w[p] = f"new{g.integers(1 << 30)}"
            out.append(" ".join(w))
    return out + [None, "", "  ", "one two", "One  two", "three"]


def kept_by_force(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and alike(texts[i], texts[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {k for k, r in enumerate(root) if k == r}


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], DOCS)


def test_stage_drops_near_copies(spark):
    texts = copies()
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, enumerate(texts)), "").collect()}
    assert found == kept_by_force(texts) and len(found) < len(texts)
    assert corpus_pipeline.near_duplicates(spark, frame(spark, []), "").count() == 0


def test_pairs_left_by_the_first_round_meet(spark, monkeypatch):
    """Blocks of two: every two texts of a key meet in some pair of blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", 2)
    texts = copies()[:18]
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, enumerate(texts)), "").collect()}
    assert found == kept_by_force(texts)


def test_rows_that_share_an_id(spark):
    """Different texts of one id all stay; of a component, one row stays, also if its smallest id names other texts too."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (2, c), (3, c), (None, c)]
    found = near_copies.keep_first(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == sorted([(0, c), (1, a), (1, b), (2, c)])


def test_rows_of_different_roots_meet(spark, monkeypatch):
    """Every two rows of a key with different roots share a pair of blocks; a key of one root is not dealt at all."""
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rows = [(1, n, 100 if n < 40 else 200 + n % 3) for n in range(50)] + [(2, n, 100) for n in range(30)] + [(3, 7, 7), (3, 8, 8)]
    dealt = near_copies.across(spark.createDataFrame(rows, "key long, node long, root long")).collect()
    places, root = {}, {(k, n): r for k, n, r in rows}
    for r in dealt:
        places.setdefault((r["key"], r["node"]), set()).add((r["bi"], r["bj"]))
    assert {k for k, _ in places} == {1, 3}
    for (k, a), x in places.items():
        assert all(x & y for (j, b), y in places.items() if j == k and root[k, a] != root[j, b])
    assert sum(r["key"] == 1 and r["node"] < 40 for r in dealt) == 40 * 4


def test_bins_lose_no_link():
    """Sets of similarity 0.8 or more differ in no more bins than their sizes allow."""
    g = np.random.default_rng(3)
    for n in (1, 9, 45, 90, 900, 9000):
        both = g.integers(1 << 63, size=n, dtype=np.uint64)
        for extra in (0, n // 9, n // 4):
            a, b = both, np.append(both, g.integers(1 << 63, size=extra, dtype=np.uint64))
            x, y = (np.frombuffer(near_copies.bins(v), np.uint8) for v in (a, b))
            assert 9 * int((x != y).sum()) <= len(a) + len(b) or 5 * n < 4 * len(b)
    assert near_copies.bins(np.zeros(0, np.uint64)) == bytes(near_copies.BINS)
