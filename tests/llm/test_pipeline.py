"""run() of the pipeline, stage by stage, against plain Python on a small fixture."""

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from tests.llm.test_near_copies import copies, kept_by_force
from tests.llm.test_short_lines import by_force

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    g = np.random.default_rng(6)
    leaked = " ".join(f"bench{k}" for k in range(60))
    texts = [t for t in copies()[:42]]
    toxic = set(range(42, 72))
    texts += [" ".join(f"t{k}" for k in g.integers(0, 5000, 30)) + " vileword nastyword" for _ in toxic]
    texts += [" ".join(f"c{k}" for k in g.integers(0, 5000, 30)) for _ in range(40)]
    shared = "All rights reserved."
    for k in (0, 6, 80, 90):
        texts[k] += "\n" + shared
    texts[100] += " " + leaked
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write(rows, DOCS, "documents")
    write([(k, 1, int(k in toxic)) for k in range(len(texts))], "doc_id long, quality int, toxic int", "labels")
    write([(1, leaked)], "item_id long, text string", "benchmark")

    want = {k: t for k, t in enumerate(texts) if k not in toxic}
    state, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, str(tmp_path))
        seen[name] = {r["doc_id"]: r["text"] for r in state.collect()}
    assert list(seen) == ["toxicity", "lines", "near_duplicates", "decontamination", "mixture"] and seen["toxicity"] == want

    gone = by_force([want.get(k) for k in range(len(texts))])
    parts = {k: t.split("\n") for k, t in want.items()}
    want = {k: "\n".join(x for n, x in enumerate(p) if n not in gone.get(k, ())) for k, p in parts.items()}
    want = {k: t for k, t in want.items() if t.strip()}
    assert seen["lines"] == want and shared in want[0] and not any(shared in want[k] for k in (6, 80, 90))

    ids = sorted(want)
    want = {ids[k]: want[ids[k]] for k in kept_by_force([want[i] for i in ids])}
    assert seen["near_duplicates"] == want and len(want) < len(ids)

    del want[100]
    assert seen["decontamination"] == seen["mixture"] == want
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want


def test_every_stage_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing column names, empty tables."""
    names = ("row", "doc", "old", "id", "dropped", "new", "key", "_words", "_spans", "_items", "_score", "_aspect_1", "_th", "slot", "th", "f")
    long = " ".join(f"v{k % 7919}" for k in range(150_000))
    rows = [(1, "some plain words here", "en", "s", 21), (1, "some plain words here", "en", "s", 21), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id at all", "en", "s", 5), (4, long, "en", "t", len(long)), (5, "other line\nother line", "en", "t", 21)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("kept") for c in names})
    for data, schema, name in (([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int", "labels"), ([(None, None), (1, "")], "item_id long, text string", "benchmark")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path)).collect()
        assert all(r[c] == "kept" for r in found for c in names) and list(found[0].asDict())[: len(docs.columns)] == docs.columns, name
        assert len(found) == {"near_duplicates": 5}.get(name, 7), name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
