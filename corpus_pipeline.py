"""The corpus pipeline: documents that are clean, distinct and mixed to target weights.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from quern.llm.common import table, written
from quern.llm.decontaminate import remove_contaminated
from quern.llm.lines import dedup_lines
from quern.llm.mixing import in_order, mix
from quern.llm.near_copies import keep_first
from quern.llm.toxicity import remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents scored toxic by a chain fitted on labelled ones of ``docs``. A null or empty text scores as one without words and repeated rows alike; columns of any name stay; an empty table stays empty."""
    return remove_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that equal an earlier one but for one edit, and without documents that lose all. Null texts and null ids stay; repeated rows stand at one place, so they lose the same lines."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first by id; null and empty texts are one group, rows without an id stay, repeated rows become one."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without contaminated documents; null and empty texts have no words and stay, repeated rows share their fate."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their place in the mixture, in reading order; a null source is one of its own."""
    return in_order(mix(docs))


STAGES = [("toxicity", toxicity), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture)]
#: The fitted classifier and the fingerprints can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage but the last written to the shared folder and read again."""
    *front, last = STAGES
    docs = reduce(lambda d, s: written(s[1](spark, d, sf_dir), s[0]), front, table(spark, sf_dir, "documents"))
    return last[1](spark, docs, sf_dir)
