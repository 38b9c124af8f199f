"""The near-duplicate stage's index: SimHash fingerprints, posted under their surest bytes."""

import numpy as np
from quern.llm import components, near_copies


def test_fingerprint_bits_are_majorities():
    """Each bit is 1 if over half the hashes of the set have it, a tie being 0."""
    g = np.random.default_rng(4)
    for n in (1, 2, 5, 300):
        s = g.integers(1 << 63, size=n, dtype=np.uint64)
        votes = [0] * (8 * near_copies.PLACES)
        for x in s.tolist():
            for w, (flip, spread) in enumerate(zip(near_copies._FLIP.tolist(), near_copies._SPREAD.tolist())):
                h = int(near_copies._mixed(np.array([(x ^ flip) * spread % (1 << 64)], dtype=np.uint64))[0])
                for bit in range(64):
                    votes[64 * w + bit] += h >> bit & 1
        want = bytes(sum((2 * votes[8 * p + bit] > n) << bit for bit in range(8)) for p in range(near_copies.PLACES))
        assert near_copies.fingerprint(s)[0] == want, n


def test_pairs_at_the_bound_share_a_list():
    """Sets of similarity 0.8 share a posting list and enough bytes, small ones too; sets without a common shingle share none."""
    g = np.random.default_rng(7)
    row = lambda x: np.frombuffer(x, np.uint8)[None]

    def met(a, b):
        (m, s), (n, t) = ((row(x) for x in near_copies.fingerprint(v)) for v in (a, b))
        return len(np.intersect1d(near_copies.keys(m, s)[1], near_copies.keys(n, t)[1])), int((m == n).sum())

    for both, left, right in ((4, 1, 0), (8, 1, 1), (80, 10, 10), (160, 40, 0)):
        for _ in range(150):
            h = g.integers(1 << 63, size=both + left + right, dtype=np.uint64)
            lists, same = met(h[: both + left], np.append(h[:both], h[both + left :]))
            assert lists and same >= near_copies.LEAST_SAME
    for _ in range(50):
        h = g.integers(1 << 63, size=200, dtype=np.uint64)
        assert met(h[:100], h[100:])[0] == 0


def test_turns_make_all_keys():
    f = [near_copies.fingerprint(np.arange(1, n, dtype=np.uint64)) for n in (3, 40, 400)]
    marks, sure = (np.array([list(x[k]) for x in f], dtype=np.uint8) for k in (0, 1))
    whole = sorted(zip(*(x.tolist() for x in near_copies.keys(marks, sure))))
    assert whole == sorted(p for turn in range(4) for p in zip(*(x.tolist() for x in near_copies.keys(marks, sure, turn, 4))))
    assert [sum(r == k for r, _ in whole) for k in range(3)] == [len(near_copies.TRIPLES), near_copies.POSTED, near_copies.POSTED]


def test_clusters_and_lists_deal_all_pairs(spark):
    """Two nodes of a list are of one cluster, or meet in the list; a cluster grows where nodes share lists with it."""
    lists = [(k, n, 0) for k in range(6) for n in (0, 1, 2)] + [(10 + k, n, 2) for k in range(4) for n in (2, 3)] + [(20, n, 1) for n in (1, 9)]
    df = spark.createDataFrame(lists, "key long, node long, v long")
    links = spark.createDataFrame([(8, 7)], "u long, v long")
    found = near_copies.clusters(df, links)
    assert {r["node"]: r["root"] for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 7: 7, 8: 7}
    dealt = near_copies.across(near_copies.with_root(df.select("node", "key"), found)).collect()
    assert {(r["key"], r["node"]) for r in dealt} == {(20, 1), (20, 9)}


def classes(spark, others, size=100, roots=None):
    """Nodes 0 and up that post one triple only, whose bytes agree; of the other bytes, ``others`` are flipped or not."""
    g = np.random.default_rng(8)
    t, base = 5, g.integers(256, size=near_copies.PLACES, dtype=np.uint8)
    sure = np.zeros(len(near_copies.TRIPLES), dtype=bool)
    sure[t] = True
    flip = np.full(near_copies.PLACES, 255, dtype=np.uint8)
    flip[near_copies.TRIPLES[t]] = 0
    rows = [(n, bytes(base ^ flip if x else base), np.packbits(sure).tobytes(), size, *([] if roots is None else [roots[n]])) for n, x in enumerate(others)]
    return spark.createDataFrame(rows, "node long, marks binary, sure binary, size long" + (", root long" if roots else ""))


def test_lists_of_unlike_texts_are_left_out(spark):
    """Two nodes that agree in a key but not in its tag share no list; small sets, alike ones and longer lists do."""
    found = lambda *a, **b: sorted(r["node"] for r in near_copies.shared(classes(spark, *a, **b)).collect())
    assert found([0, 1]) == []
    assert found([0, 0]) == found([0, 1], size=near_copies.SMALL) == [0, 1]
    assert found([0, 1, 1]) == [0, 1, 2]


def test_lists_of_one_cluster_are_left_out(spark):
    """Dealt anew with roots, a list stays only if it holds two of them, with the least as its v."""
    assert near_copies.shared(classes(spark, [0, 0, 1], roots=[7, 7, 7])).count() == 0
    got = near_copies.shared(classes(spark, [0, 0, 1], roots=[7, 7, 3])).collect()
    assert sorted((r["node"], r["root"], r["v"]) for r in got) == [(0, 7, 3), (1, 7, 3), (2, 3, 3)]


def test_joined_in_one_task_equals_the_rounds(spark, monkeypatch):
    g = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in g.integers(-60, 60, (70, 2))] + [(k, k + 1) for k in range(100, 140)]
    df = spark.createDataFrame(edges, "u long, v long")
    some = lambda e: {(r["node"], r["root"]) for r in components.joined(e).collect()}
    one = some(df)
    assert one and some(df.where("false")) == set()
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert one == some(df)
