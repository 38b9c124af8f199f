"""Repeated passages against all windows of all documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from quern.llm import repeats


def by_force(texts):
    """{doc: (repeated word positions, those that are not the first copy)}."""
    seats = {}
    words = [(t or "").lower().split() for t in texts]
    for d, w in enumerate(words):
        for s in range(len(w) - repeats.MIN_WORDS + 1):
            seats.setdefault(tuple(w[s : s + repeats.MIN_WORDS]), []).append((d, s))
    out = {}
    for found in seats.values():
        if found[0][0] != found[-1][0]:
            for k, (d, s) in enumerate(found):
                hit, cut = out.setdefault(d, (set(), set()))
                hit.update(range(s, s + repeats.MIN_WORDS))
                if k:
                    cut.update(range(s, s + repeats.MIN_WORDS))
    return out


def corpus():
    """Shared passages of 49 to 130 words in surroundings of few words, some with one word changed, some twice in a document."""
    g = np.random.default_rng(12)
    prose = lambda n: " ".join(f"w{k}" for k in g.integers(0, 40, n))
    passages = [prose(int(n)) for n in (49, 50, 51, 74, 75, 76, 90, 130)]
    texts = [None, "", prose(30), "y " * 400, "Y " * 80]
    for k in range(60):
        parts = [prose(int(g.integers(0, 40)))]
        for p in g.choice(8, int(g.integers(1, 3))):
            w = passages[p].split()
            if g.random() < 0.3:
                w[int(g.integers(len(w)))] = "changed"
            parts += [" ".join(w), prose(int(g.integers(0, 30)))]
        texts.append(" ".join(parts))
    return texts


def positions(spans):
    return {p for s in spans for p in range(s["s"], s["e"])}


@pytest.mark.parametrize("common", [10_000, 20])
def test_against_all_windows(spark, monkeypatch, common):
    """Also with passages of more than 20 rows taken as common."""
    monkeypatch.setattr(repeats, "COMMON_ROWS", common)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "cuts", "row", "doc", "old")})
    found = {r["doc_id"]: (positions(r["spans"]), positions(r["cuts"])) for r in repeats.repeated_spans(docs).collect()}
    assert found == by_force(texts) and len(found) > 40
    if common == 20:
        left = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(docs).collect()}
        want = {d: " ".join(w for p, w in enumerate(t.split()) if p not in found[d][1]) if found.get(d, (0, 0))[1] else t for d, t in enumerate(texts) if t is not None}
        assert left == {0: None, **want}
