"""Values worked out by hand: links of small indexes, outline texts, invalidation, files and indexes that are broken."""

import math

import pytest
from quern.operators.connections import file_connections, get_token_stats, top_connections
from quern.operators.index_store import invalidate, load_index, missing_outlines, purge_outlines, save_index
from quern.operators.render import render_outline
from quern.operators.routing import CACHE_VERSION, handlers, hook_log, route_reads, session_context
from quern.operators.tokens import token_occurrences
from quern.operators.tree import outline_nodes
from quern.plans.outline import generate_outlines
from quern.sources.files import append_log, read_files, write_outlines
from quern.streaming.reads import decide, event_stream, route_stream
from tests.test_connections import occurrences


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file_id string, content string")


def edges(spark, texts, source=None):
    only = None if source is None else spark.createDataFrame([(source,)], "file_id string")
    return file_connections(token_occurrences(files(spark, texts)), only).collect()


def test_rare_symbol_of_six_files(spark):
    texts = {f"/f{k}.ts": f"const only{'abcdef'[k]} = 1;" for k in range(6)}
    texts["/f0.ts"], texts["/f1.ts"] = "function rareSymbol() {", "one line\ncall(rareSymbol);"
    (edge,) = edges(spark, texts, "/f1.ts")
    assert edge["target_file"] == "/f0.ts" and set(edge["shared_tokens"]) == {"raresymbol", "rare", "symbol"}
    assert math.isclose(edge["strength"], 3 * math.log2(3)) and edge["direction"] == "incoming" and edge["type"] == "api_dependency"


def test_ten_files_and_the_limit_by_first_shared_token(spark):
    """Three equal links; the first of them is the one whose token comes first in the source, not the first target by name."""
    rows = [("/a.ts", t, "header") for t in ("zeta", "beta", "mid")] + [("/b.ts", "mid", "body"), ("/c.ts", "beta", "body"), ("/d.ts", "zeta", "body")]
    rows += [(f"/x{k}.ts", f"own{k}", "body") for k in range(6)]
    found = file_connections(occurrences(spark, rows), spark.createDataFrame([("/a.ts",)], "file_id string"))
    top = top_connections(found, 0).orderBy("rank").collect()
    assert [r["target_file"] for r in top] == ["/d.ts", "/c.ts", "/b.ts"] and all(math.isclose(r["strength"], math.log2(5)) for r in top)
    assert [r["target_file"] for r in top_connections(found, 1).collect()] == ["/d.ts"]


def test_stats_of_a_token(spark):
    rows = [("a", "name", "header"), ("a", "name", "body"), ("b", "name", "body"), ("c", "other", "body")]
    (r,) = get_token_stats(occurrences(spark, rows), "Name").collect()
    assert (r["file_count"], r["header_count"], r["body_count"]) == (2, 1, 2) and math.isclose(r["idf"], math.log2(1.5))
    assert get_token_stats(occurrences(spark, rows), "none").count() == 0


def test_three_functions(spark):
    """Fifteen lines; the last delimiter joins the node before it."""
    lines = ["function hello() {", "  const x = 1;", "  return x;", "}", "", "function world() {", "  const y = 2;", "  return y;", "}", "", "function another() {", "  const z = 3;", "  const v = 4;", "  return z + v;", "}"]
    (outline,) = generate_outlines(files(spark, {"/src/three.js": "\n".join(lines)}), with_connections=False).collect()
    assert outline["outline"].split("\n") == ["three.js [15 lines]", "  ---", "  [1-4] 1:function hello() {", "  [5-9] 6:function world() {", "  [10-15] 11:function another() {"]


def test_depth_zero_is_kept(spark):
    text = "\n".join(x for k in range(4) for x in (f"class A{k} {{", *(f"  int field{k}{j} = {j * k};" for j in range(20 + k)), "}", ""))
    one = files(spark, {"/a.java": text})
    (shallow,), (deep,) = generate_outlines(one, 0, False).collect(), generate_outlines(one, None, False).collect()
    assert len(shallow["outline"].split("\n")) <= len(deep["outline"].split("\n"))
    (leaf,) = outline_nodes(one, 0).collect()
    assert (leaf["start_line"], leaf["end_line"]) == (1, text.count("\n") + 1) and shallow["outline"].endswith("1:class A0 {")


def test_links_in_an_outline(spark):
    texts = {"/p/a.ts": "class betaProcessor {", "/p/b.ts": "one\nuse(betaProcessor)", "/p/c.ts": "plain = 1"}
    found = {r["file_id"]: r["outline"] for r in generate_outlines(files(spark, texts)).collect()}
    assert "connections: → b.ts" in found["/p/a.ts"] and "connections: ← a.ts" in found["/p/b.ts"] and "connections" not in found["/p/c.ts"]
    (edge,) = edges(spark, texts, "/p/a.ts")
    assert set(edge["shared_tokens"]) == {"betaprocessor", "beta", "processor"} and math.isclose(edge["strength"], 3 * math.log2(1.5))


def test_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "bad.py").write_bytes(b"ok \xff\xfe end\r\nnext")
    found = {r["file_id"].rsplit("/", 1)[1]: r["content"] for r in read_files(spark, str(tmp_path)).collect()}
    assert found == {"bad.py": "ok \ufffd\ufffd end\r\nnext"}


def test_broken_markers(spark, tmp_path):
    folder = str(tmp_path / "index")
    save_index(occurrences(spark, [("a", "t", "header")]), folder)
    save_index(occurrences(spark, [("a", "t", "header"), ("b", "t", "body")]), folder)
    assert load_index(spark, folder).count() == 2
    (tmp_path / "index" / "current" / "part-broken.json").write_text('{"path": \nnot json\n{"at": 99999999999999999, "path": "/nowhere/at/all"}\n')
    assert load_index(spark, folder).count() == 2
    only = tmp_path / "other" / "current"
    only.mkdir(parents=True)
    (only / "part.json").write_text("garbage")
    assert load_index(spark, str(tmp_path / "other")).count() == 0


def test_cache_and_invalidation(spark, tmp_path):
    wanted = spark.createDataFrame([("/a", 5200.0), ("/b", 7000.0), ("/c", 1.0)], "file_path string, mtime double")
    made = missing_outlines(wanted, spark.createDataFrame([], "path_hash string, mtime_s long, version int"))
    assert made.count() == 3
    cached = made.select("path_hash", "mtime_s", "version").collect()
    old = spark.createDataFrame([(r[0], r[1], CACHE_VERSION - (k == 1), "text") for k, r in enumerate(cached)], "path_hash string, mtime_s long, version int, outline string")
    assert [r["file_path"] for r in missing_outlines(wanted, old).collect()] == [r["file_path"] for k, r in enumerate(made.collect()) if k == 1]
    edits = spark.createDataFrame([("/a", True), ("/gone", False), ("", True), (None, True)], "file_path string, exists boolean")
    outlines, index, log = invalidate(edits, old, occurrences(spark, [("/a", "t", "header"), ("/b", "t", "body")]))
    assert outlines.count() == 2 == purge_outlines(old, edits.where("exists AND file_path = '/a'")).count()
    assert [r["file_id"] for r in index.collect()] == ["/b"]
    assert [(r["response"], r["decision"]) for r in log.collect()] == [("{}", "invalidated"), ("{}", None), ("{}", None), ("{}", None)]
    write_outlines(old, str(tmp_path / "o"))
    append_log(log.where("decision IS NOT NULL"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == 3 and spark.read.json(str(tmp_path / "log")).count() == 1


def test_events(spark):
    events = spark.createDataFrame([("SessionStart", None, "startup"), ("PreToolUse", "Read", ""), ("PostToolUse", "Edit", None), ("PostToolUse", "Read", None), ("", None, None)], "hook_event_name string, tool_name string, source string")
    assert [r["handler"] for r in handlers(events).collect()] == ["session_start", "pre_read", "post_edit", None, None]
    found = session_context(events, "hi").collect()
    assert found[0]["response"] == '{"hookSpecificOutput":{"hookEventName":"SessionStart","additionalContext":"hi"}}' == found[4]["response"]
    assert [r["logged_source"] for r in found[:2]] == ["startup", "unknown"]


READS = [(1, "/f", None, 350, True, False), (2, "/f", "10", 350, True, False), (3, "/h", None, 150, False, False), (4, "/h", None, 150, False, False), (5, "/h", None, 150, True, True), (6, "/h", None, 150, True, False), (7, "/i", None, 20, True, False), (8, "/h", "x", 150, False, True)]


def test_stream_decides_as_the_batch_form(spark, tmp_path):
    schema = "seq long, file_path string, offset string, newline_count int, outline_ok boolean, outline_empty boolean, mtime_s long"
    events = spark.createDataFrame([(*r, 0) for r in READS], schema)
    want = {r["seq"]: r["decision"] for r in route_reads(events).orderBy("seq").collect()}
    assert list(want.values()) == ["outline_always", "passthrough_targeted_ctx", "passthrough_first_read", "passthrough_outline_failed", "passthrough_empty_outline", "outline_repeat", "passthrough_small", "outline_repeat"]
    assert hook_log(route_reads(events)).where("cache_hit = false").count() >= 2
    for part in (events.where("seq <= 4"), events.where("seq > 4")):
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = route_stream(stream).writeStream.format("memory").queryName("decided").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r["seq"]: r["decision"] for r in spark.table("decided").collect()} == want
    assert event_stream(spark, str(tmp_path / "in")).isStreaming


@pytest.mark.parametrize("n, targeted, want", [(99, False, "passthrough_small"), (100, False, "passthrough_first_read"), (299, False, "passthrough_first_read"), (300, False, "outline_always"), (300, True, "passthrough_targeted")])
def test_thresholds(n, targeted, want):
    assert decide(n, targeted, False, False)[0] == want
