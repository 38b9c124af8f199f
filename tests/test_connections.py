import math

from quern.operators.connections import file_connections, top_connections
from quern.operators.index_store import live_files, load_index, remove_files, replay_connections, save_index, upsert_files
from quern.operators.render import render_outline
from quern.operators.routing import parse_events, responses, route_reads
from quern.operators.tokens import OCCURRENCES
from quern.operators.tree import NODES


def occurrences(spark, rows):
    return spark.createDataFrame([(f, t, t, p, "", 1, 0, 1, k) for k, (f, t, p) in enumerate(rows)], OCCURRENCES)


def test_edges(spark):
    rows = [("a", "rare", "header"), ("b", "rare", "body"), ("c", "x", "body"), ("d", "y", "body"), ("e", "z", "body"), ("f", "q", "body")]
    found = {(r["source_file"], r["target_file"]): r for r in file_connections(occurrences(spark, rows)).collect()}
    assert set(found) == {("a", "b"), ("b", "a")}
    assert found["a", "b"]["direction"] == "outgoing" and found["b", "a"]["direction"] == "incoming"
    assert math.isclose(found["a", "b"]["strength"], math.log2(3))


def test_two_files_have_strength_zero(spark):
    (edge,) = file_connections(occurrences(spark, [("a", "t", "header"), ("b", "t", "header")]), spark.createDataFrame([("a",)], "file_id string")).collect()
    assert (edge["type"], edge["strength"]) == ("shared_interface", 0.0)


def test_band_and_limit(spark):
    rows = [(f, "common", "body") for f in "abcdef"] + [("a", "p", "header"), ("b", "p", "body"), ("c", "p", "body")]
    edges = file_connections(occurrences(spark, rows))
    assert edges.where("array_contains(shared_tokens, 'common')").count() == 0
    assert top_connections(edges.where("source_file = 'a'"), 1).count() == 1 and top_connections(edges.where("source_file = 'a'"), 0).count() == 2


def test_index(spark, tmp_path):
    index = occurrences(spark, [("a", "t", "header"), ("b", "t", "body")])
    gone = spark.createDataFrame([("a",), ("nope",)], "file_id string")
    assert [r["file_id"] for r in remove_files(index, gone).collect()] == ["b"]
    assert upsert_files(index, occurrences(spark, [("a", "u", "body")]), gone).count() == 2
    assert load_index(spark, str(tmp_path / "none")).count() == 0
    save_index(index, str(tmp_path / "i"))
    assert load_index(spark, str(tmp_path / "i")).count() == 2
    touches = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 0)], "file_id string, seq long")
    assert [r["file_id"] for r in live_files(touches, 2).collect()] == ["a", "b"]
    replay = replay_connections(index, ["a", "b"])
    assert replay["a"].count() == 0 and replay["b"].count() == 1


def test_render(spark):
    nodes = spark.createDataFrame([("/x/f.py", 0, None, 0, 1, 1, 9, "top", 2, 0, 1.0, 1.0, False, None, None), ("/x/f.py", 1, 0, 0, 2, 1, 4, "kid", 1, 0, 1.0, 1.0, False, None, None), ("/x/f.py", 2, 0, 1, 2, 5, 9, "3 similar regions (5 lines)", 5, 0, 1.0, 1.0, True, "s", "3 similar regions")], NODES)
    files = spark.createDataFrame([("/x/f.py", 9)], "file_id string, line_count int")
    full = render_outline(files, nodes).first()["outline"]
    assert full == "f.py [9 lines]\n  ---\n  [1-9] 2:top\n    [1-4] 1:kid\n    [5-9] 3 similar regions\n      sample: s"
    assert render_outline(files, nodes, None, 1).first()["outline"].endswith("  [1-9] ... (2 children)")


def test_routing(spark):
    rows = [(1, "/f", None, 350), (2, "/f", "10", 350), (3, "/g", "0", 400), (4, "/h", None, 150), (5, "/h", None, 150), (6, "/i", None, 99), (7, "", None, 5), (8, "/f", "x", 350)]
    events = spark.createDataFrame([(*r, 0) for r in rows], "seq long, file_path string, offset string, newline_count int, mtime_s long")
    routed = route_reads(events)
    got = {r["seq"]: r["decision"] for r in routed.collect()}
    assert got == {1: "outline_always", 2: "passthrough_targeted_ctx", 3: "passthrough_targeted", 4: "passthrough_first_read", 5: "outline_repeat", 6: "passthrough_small", 7: None, 8: "outline_always"}
    answers = {r["seq"]: r["response"] for r in responses(routed).collect()}
    assert answers[6] == "{}" and "updatedInput" in answers[1] and "additionalContext" in answers[2]


def test_payloads(spark):
    raw = spark.createDataFrame([('{"tool_input": {"file_path": "/a", "offset": "3"}}',), ('{"file_path": "/b"}',), ("not json",)], "value string")
    assert [(r["file_path"], r["offset"]) for r in parse_events(raw).collect()] == [("/a", "3"), ("/b", None), (None, None)]
