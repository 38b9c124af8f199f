"""Outlines and links of sources, text by text, against those of the joined files."""

import pytest
from quern.operators import joined as J
from quern.operators import tree as T
from quern.operators.connections import file_connections
from quern.operators.tokens import token_occurrences
from quern.plans.outline import generate_outlines
from quern.plans.queries import QUERIES, edge_columns
from quern.sources import files as S

ODD = [
    (5, "a", None), (1, "a", "alpha only\nbeta gam"), (1, "a", "alpha only\nbeta gam"), (2, "a", "# comment one\n\n"), (3, "b", "# note first\n // remark"), (None, "b", "before plain\nlast"), (7, "b", ""), (9, "c", None),
    (6, "d", "solo alpha"), (8, "d", "\n\nsolo two\r\nbeta über \U0001f600\U0001f600"), (10, "e", "  \n"), (11, "e", "#x gam\nalpha betaGam\nbetagam beta_gam"), (12, "f", "gam"), (13, "g", "zed fooBarBaz"), (14, "g", "plain one\nfoobarbaz"),
] + [(100 + k, "long", "\n".join(f"    call{j % 7}(alpha, {k});" if j % 3 else f"def name{k}_{j}() {{" for j in range(40)) + "\n}") for k in range(30)]


def test_queries_equal_those_of_joined_files(spark, tmp_path):
    odd = str(tmp_path)
    spark.createDataFrame(ODD, "doc_id long, source string, text string").write.parquet(f"{odd}/documents.parquet")
    for folder in (odd, "/root/testdata/sf0.001"):
        files = S.sources_as_files(spark, folder)
        found = {tuple(r) for r in QUERIES["outline_text"](spark, folder).collect()}
        assert found == {tuple(r) for r in generate_outlines(files).collect()} and len(found) > 5
        links = {tuple(r) for r in QUERIES["tree_connections"](spark, folder).collect()}
        assert links == {tuple(r) for r in edge_columns(file_connections(token_occurrences(files))).collect()} and len(links) > 5


@pytest.mark.parametrize("name", ["outline_text", "tree_connections"])
def test_no_row_holds_a_source(spark, monkeypatch, name):
    monkeypatch.setattr(S, "sources_as_files", None)
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_names_seen_are_bounded(spark, monkeypatch):
    """Names that are forgotten come again, later."""
    lines = ODD[-1][2].split("\n")
    whole = [r for r in J.tree_rows("x", lines, T.Signals(lines)) if r[-1]]
    monkeypatch.setattr(J, "SEEN", 3)
    again = [r for r in J.tree_rows("x", lines, T.Signals(lines)) if r[-1]]
    first = lambda rows: list(dict.fromkeys(r[-2:] for r in rows))
    assert len(again) > len(whole) and first(again) == first(whole)


def test_wide_means():
    x = [((k * 7919) % 1000) / 7 for k in range(5000)]
    for window in (15, 1001, 2400):
        half = window // 2
        plain = [sum(x[max(0, i - half) : i + half + 1]) / len(x[max(0, i - half) : i + half + 1]) for i in range(len(x))]
        assert all(abs(a - b) < 1e-9 for a, b in zip(T.smooth(x, window), plain)) and len(T.smooth(x, window)) == len(x)
    assert list(T.smooth([], 5)) == [] and list(T.smooth([1.0, 2.0], 15)) == [1.5, 1.5]
