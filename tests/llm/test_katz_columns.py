"""op3's columns against plain Python: Katz of order two with all pairs."""

from collections import Counter

import numpy as np
import pytest
from quern.llm import katz


def plain_discounts(counts):
    n = Counter(counts)
    top = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, 6):
        star = (r + 1) * n[r + 1] / n[r] if n[r] else 0.0
        d = (star / r - top) / (1 - top) if top < 1 else 0.0
        out[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return out


def plain_scores(train, texts):
    """(n_tokens, n_known, base_score, score) of each text."""
    cut = lambda t: (t or "").lower().split() + ["</s>"]
    words, pairs = Counter(), Counter()
    for t in train:
        w = cut(t)
        words.update(w)
        pairs.update(zip(["<s>", *w], w))
    total = sum(words.values())
    d1, d2 = plain_discounts(words.values()), plain_discounts(pairs.values())
    kept = sum(d1.get(c, 1) * c for c in words.values()) / total
    unknown = max(1 - kept, 1 / (total + 1))
    p1 = {w: d1.get(c, 1) * c / total * (1 - unknown) / kept for w, c in words.items()}
    history = words | Counter({"<s>": len(train)})
    after = {}
    for (h, w), c in pairs.items():
        after.setdefault(h, {})[w] = d2.get(c, 1) * c / history[h]
    z, alpha = {}, {}
    for h, found in after.items():
        share = sum(found.values())
        left = max(1 - share, 1 / (history[h] + 1))
        z[h], alpha[h] = (1 - left) / share, left / (1 - sum(p1[w] for w in found))
    out = []
    for t in texts:
        w = cut(t)
        score = base = 0.0
        for h, x in zip(["<s>", *w], w):
            seen = after.get(h, {})
            score += np.log10(seen[x] * z[h] if x in seen else alpha.get(h, 1.0) * p1.get(x, unknown))
            base += np.log10((words[x] + katz.ADD) / (total + katz.ADD * (len(words) + 1)))
        out.append((len(w), sum(x in words for x in w), base, score))
    return out


def corpus():
    g = np.random.default_rng(8)
    vocab = [f"w{k}" for k in range(60)]
    draw = lambda n: " ".join(vocab[min(59, int(g.exponential(12)))] for _ in range(n))
    train = [draw(int(n)) for n in g.integers(1, 60, 40)] + ["", None, "Only here once"]
    return train, [*train[:8], draw(50), "never seen words", "w1 unseen w2", "", None, "only here twice", draw(20_000)]


@pytest.mark.parametrize("heavy, hot", [(False, True), (True, True), (True, False)])
def test_scores(spark, monkeypatch, heavy, hot):
    """Also with words spread over all buckets, and with every key asked for where it was counted."""
    if heavy:
        monkeypatch.setattr(katz, "HEAVY_SAMPLE", 1)
        monkeypatch.setattr(katz, "HEAVY_SHARE", 1 / 40)
    if not hot:
        monkeypatch.setattr(katz, "HOT_SHARE", 2)
    train, texts = corpus()
    frame = lambda t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    model = katz.Katz(frame(train).select("text"))
    assert (len(model.heavy) > 5) == heavy
    found = {r["doc_id"]: r for r in model.score(frame(texts)).collect()}
    for k, want in enumerate(plain_scores(train, texts)):
        got = tuple(found[k][c] for c in ("n_tokens", "n_known", "base_score", "score"))
        assert got[:2] == want[:2] and np.allclose(got[2:], want[2:], rtol=1e-9), (k, got, want)


def test_every_history_sums_to_one(spark):
    train, _ = corpus()
    frame = spark.createDataFrame([(t,) for t in train], "text string")
    model = katz.Katz(frame)
    blocks = [katz.Pairs(r["block"]) for r in model.counts.where("ord = 2").collect()]
    p1 = {w: p for b in blocks for w, p in zip(b.words.tolist(), model.single(b.counts(model.heavy, model.heavy_counts)))}
    assert abs(sum(p1.values()) + model.unknown - 1) < 1e-9
    rows = [katz._unpack(r["block"]) for r in model.weights.where("kind = 'weights'").collect()]
    alphas = {h: alpha for hs, a in rows for h, alpha in zip(hs.tolist(), a)}
    kept, count = Counter(), Counter()
    mass = dict(alphas)
    for b in blocks:
        for h, w, c in zip(b.histories[b.of].tolist(), b.words[b.word].tolist(), b.c):
            kept[h] += katz.discounted(c, model.d2)
            count[h] += int(c)
            mass[h] -= alphas[h] * p1[w]
    for h, c in count.items():
        mass[h] += 1 - max(1 - kept[h] / c, 1 / (c + 1))
    assert len(mass) > 40 and all(abs(m - 1) < 1e-9 for m in mass.values())


def test_no_rows_and_odd_rows(spark):
    """No training rows: every word is unknown. Null ids, repeated rows and extra columns pass."""
    none = spark.createDataFrame([], "text string")
    rows = [(1, "a b", 1, "x"), (1, "a b", 1, "x"), (None, None, 2, "y"), (2, "", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch long, kind string")
    assert katz.Katz(none).score(docs.select("doc_id", "text").where("false")).count() == 0
    found = katz.Katz(none).score(docs).collect()
    assert len(found) == 4 and all(r["n_known"] == 0 for r in found)
    found = katz.Katz(docs).score(docs).collect()
    assert sorted(r["n_tokens"] for r in found) == [1, 1, 3, 3] and all(r["n_known"] == r["n_tokens"] for r in found)
