"""Every registered query against its DuckDB form at the smallest scale, and plan shape."""

import duckdb
import pytest
from quern.functions import text as T
from quern.operators import tree as P
from quern.plans.queries import ORACLES, QUERIES
from quern.sources.files import TABLES
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert rows(found) == rows(duck.sql(ORACLES[name]).df())
    else:
        assert len(found)


def test_column_and_python_signals_agree(spark):
    lines = ["", "\t  a", "{[(", "<div>", "</div>", "<br/>", "   ", " ", "aab", "# x", "é" * 4]
    c = F.col("line")
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(T.shannon_entropy(c), T.indent_depth(c), T.bracket_delta(c), T.tag_delta(c), T.is_blank(c)).collect()
    for line, row in zip(lines, got):
        assert (round(row[0], 9), *row[1:]) == (round(P.shannon_entropy(line), 9), P.indent_depth(line), P.bracket_delta(line), P.tag_delta(line), not P.trim(line))


def test_scan_reads_only_needed_columns(spark):
    plan = QUERIES["line_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
