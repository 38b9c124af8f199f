import math

from quern.operators import tree as T
from quern.operators.tokens import compound_parts, distinct_tokens

THREE = "function hello() {\n  return 1;\n}\n\nfunction world() {\n  const x = 2;\n  return x;\n}\n\nfunction another() {\n  const y = 3;\n  return y + 1;\n}".split("\n")


def test_signals():
    assert [T.shannon_entropy(x) for x in ("ab", "aaaa", "")] == [1.0, 0.0, 0.0]
    assert math.isclose(T.jaccard_similarity("function hello() {", "function world() {"), 9 / 23)
    assert (T.jaccard_similarity("ab", "cd"), T.jaccard_similarity("ab", "abc")) == (1.0, 0.0)
    assert T.indent_depth("\t  hello") == 6
    assert [round(x, 9) for x in T.smooth([1, 1, 3, 3, 3])] == [round(x, 9) for x in (5 / 3, 2, 2.2, 2.5, 3)]
    assert [T.tag_delta(x) for x in ("<a>", "</a>", "<br />", '<a href="/x">', "<p>x</p>", "<aé>")] == [1, -1, 0, 0, 0, 1]
    assert T.gradients([1.0, 3.0, 2.0]) == [0.0, 2.0, 1.0]


def test_blank_and_single_line_files():
    (leaf,) = T.analyze_lines(["", "", "", ""])
    assert (leaf.label, leaf.start_line, leaf.end_line, leaf.label_line, leaf.entropy, leaf.similarity) == ("(empty)", 1, 4, 1, 0, 1)
    (one,) = T.analyze_lines(["  only"])
    assert (one.label, one.depth, one.similarity) == ("only", 2, 1.0)
    assert T.analyze_lines([]) == []


def test_functions_cover_the_file_and_closers_merge():
    nodes = T.analyze_lines(THREE)
    assert nodes[0].start_line == 1 and nodes[-1].end_line == len(THREE)
    assert [n.label for n in nodes] == ["function hello() {", "function world() {", "function another() {"]
    assert all(a.end_line + 1 == b.start_line for a, b in zip(nodes, nodes[1:]))


def test_similar_regions_collapse():
    lines = [x for k in range(30) for x in (f"  get field{k}() {{", f"    return this._field{k};", "  }", "")]
    assert len(T.analyze_lines(lines)) < 30
    assert any(n.collapsed for *_, n in T.preorder(T.analyze_lines(lines)))


def test_separator_and_heading_cuts():
    rules = {c.at: c.score for c in T.Outline(["// ========", "# one", "text", "", "###### six"]).candidates(0, 5)}
    assert rules[0] == 5 and math.isclose(rules[1], 4.5 * 0.4) and rules[3] == 0 and rules[4] == 1.0


def test_tokens():
    assert compound_parts("HTTPServerError") == ["HTTP", "Server", "Error"]
    assert compound_parts("aBC") == [] and compound_parts("getX2Value") == ["get", "X2Value"] and compound_parts("x_HttpServer") == ["HttpServer"]
    assert [t[0] for t in distinct_tokens([(1, "httpserver HTTPServer")])] == ["httpserver"]
