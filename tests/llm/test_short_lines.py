"""Line deduplication of lines of any length against plain Python."""

import numpy as np
from quern.llm import lines

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :] or a == b)


def by_force(texts):
    before, out = [], {}
    for d, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            x = line.strip(" \t\r").lower()
            if not x:
                continue
            if any(within_one(x, y) for y in before):
                out.setdefault(d, []).append(k)
            before.append(x)
    return out


def test_short_lines(spark):
    g = np.random.default_rng(3)
    texts = ["All rights reserved.\nlicensed under cc by-nc 4.0.", "", None, "all rights reserved. \nx\n\nlicensed under cc by-nc 4.1.", "é\nöl\n7", "8\nalle rights reserved."]
    alphabet = list("abcdefghijé ")
    texts += ["\n".join("".join(g.choice(alphabet, int(n))) for n in g.integers(0, 29, 6)) for _ in range(60)]
    some = [x for t in texts[6:40] for x in t.split("\n") if len(x) > 3]
    texts += ["\n".join(x[:p] + c + x[p + cut :] for x, p, c, cut in zip(g.choice(some, 6), g.integers(0, 4, 6), g.choice(list("xyz"), 6), g.integers(0, 2, 6))) for _ in range(20)]
    found = lines.dropped_lines(spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOCS))
    want = by_force(texts)
    assert {r["doc_id"]: r["dropped"] for r in found.collect()} == want and len(want) > 20


def test_short_segment_keys_meet_after_any_single_edit():
    g = np.random.default_rng(4)
    for n in range(1, 30):
        line = "".join(g.choice(list("abcdé"), n))
        for p in range(n):
            for other in (line[:p] + "Z" + line[p + 1 :], line[:p] + line[p + 1 :], line[:p] + "Z" + line[p:], line + "Z"):
                for size in (2, lines.SEGMENTS):
                    assert not other or set(lines.segment_keys(line.encode(), size)) & set(lines.segment_keys(other.encode(), size))
