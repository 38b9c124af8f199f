"""Mixtures against their target weights at every slot, and odd rows."""

from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F
from quern.llm import mixing

DOCS = "doc_id long, text string, source string"


def schedule(spark, weights):
    sizes = spark.createDataFrame([(f"={k}", 1) for k in weights], "key string, c long")
    return mixing.period_slots(mixing.shares(sizes, weights)).orderBy("slot").collect()


@pytest.mark.parametrize("weights", [{f"s{k}": 0.1 / 99 if k else 0.9 for k in range(100)}, {f"s{k}": "0.9" if not k else "0.001" for k in range(101)}, {"a": 3, "b": 1, "c": 1}, {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}])
def test_no_source_is_a_block_off_its_weight(spark, weights):
    """Against w / W at every slot of a period."""
    slots = schedule(spark, weights)
    exact = {f"={k}": Fraction(str(w)) for k, w in weights.items()}
    whole = sum(exact.values())
    assert [r["slot"] for r in slots] == list(range(len(slots)))
    had = Counter()
    for t, r in enumerate(slots, 1):
        had[r["key"]] += 1
        assert r["release"] <= r["slot"] < r["due"]
        assert all(abs(had[k] - t * w / whole) < 1 for k, w in exact.items()), (t, had)


def test_weights_without_a_short_period(spark):
    """Rounded to the longest period, and no further off than that rounding."""
    weights = {"a": 0.7071067811865476, "b": 0.3141592653589793, "c": 1e-9}
    p = {r["key"]: r["p"] for r in mixing.shares(spark.createDataFrame([(f"={k}", 1) for k in weights], "key string, c long"), weights).collect()}
    whole = sum(weights.values())
    assert p["=c"] == 1 and all(abs(p[f"={k}"] / sum(p.values()) - w / whole) < 1 / 10_000 for k, w in weights.items())


def test_default_weights_and_blocks(spark):
    rows = [(k, "x" * 100, None if k % 7 == 0 else f"s{k % 3}") for k in range(600)]
    out = mixing.mix(spark.createDataFrame(rows, DOCS), {"s0": 3.0, "s1": 1.0, "s2": 1.0}, block_chars=1000).toPandas()
    assert len(out) == 600 and ((out.mix_slot >= out.mix_release) & (out.mix_slot < out.mix_due)).all()
    assert out.groupby([out.source.fillna(""), "mix_block"]).size().max() == 10
    first = out[out.mix_slot < 30].drop_duplicates(["source", "mix_block"]).groupby(out.source.fillna("")).size()
    assert first.to_dict() == {"": 5, "s0": 15, "s1": 5, "s2": 5}


def test_odd_rows(spark):
    """Nulls, repeated rows, a very long text, clashing columns, no weights; an empty table."""
    rows = [(1, "ab", "s"), (1, "ab", "s"), (2, None, None), (None, "", "s"), (None, "x", None), (3, "y" * 300_000, "t"), (4, "z", "t")]
    names = ("key", "id", "row", "slot", "total", "release", "due", "p", "j", "range", "in", "at", "before", "chars", "mix_slot")
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("kept") for c in names})
    for weights in (None, {}):
        out = mixing.mix(docs, weights).toPandas()
        assert len(out) == 7 and list(out.columns) == [*[c for c in docs.columns if c != "mix_slot"], *mixing.MIXED]
        assert (out[list(names[:-1])] == "kept").all().all() and set(out.mix_block) <= {0, 4}
    assert mixing.mix(docs.where("false")).count() == 0 == mixing.in_order(mixing.mix(docs.where("false"), {"s": 1})).count()
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s": 0})
