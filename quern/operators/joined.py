"""Outline trees of files that are joined from many texts, without any text or row that holds a whole file.

The figures of lines are made where the texts are. Then each file's texts go, in
order, through one task, which keeps packed figures of its lines (about 40 bytes a
line) and puts the text into a temporary file of its own. A tree is a chain of folds
over the lines of its file, so one file is the unit of this step.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quern.operators import tokens as K
from quern.operators.tree import NODES, Outline, Signals, StoredLines, joined, preorder

#: Rows of one Arrow batch out, and texts that are looked at together.
ROWS, TEXTS = 20_000, 500
#: Names of a file that are remembered as seen; beyond, rows may repeat with later ordinals.
SEEN = 1_000_000
TREE = f"{NODES}, normalized string, position string"
_parts = lru_cache(1 << 17)(lambda token: tuple(p.lower() for p in K.compound_parts(token)))


def _body(text: str) -> Iterator[str]:
    """Normal forms of ``distinct_tokens``, by first appearance."""
    seen: set[str] = set()
    for token in dict.fromkeys(K._TOKEN.findall(text)):
        low = token.lower()
        if low not in seen:
            seen.add(low)
            yield low
            for part in _parts(token):
                if part not in seen:
                    seen.add(part)
                    yield part


def tree_rows(file_id: str | None, lines: StoredLines | list[str], signals: Signals) -> Iterator[tuple]:
    """Node rows, and a row for each name and position of the file with the place of its first occurrence among them."""
    seen: dict[str, set[str]] = {"header": set(), "body": set()}
    count = 0
    for number, parent, k, depth, n in preorder(Outline(lines, None, signals).children):
        yield file_id, number, parent, k, depth, n.start_line, n.end_line, n.label, n.label_line, n.depth, n.entropy, n.similarity, n.collapsed, n.sample_line, n.pattern, None, None
        for position, text in (("header", n.label), ("body", joined(lines, n.start_line, min(n.end_line, len(lines))))):
            known = seen[position]
            for name in _body(text):
                if name not in known:
                    known.add(name)
                    yield (file_id, None, None, count, *[None] * 11, name, position)
                    count += 1
            if len(known) > SEEN:
                known.clear()


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in TREE.split(", "))])


def _batches(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    schema, held = _schema(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield out()
            held = []
    if held:
        yield out()


def joined_trees(texts: DataFrame) -> DataFrame:
    """texts(file_id, doc_id, text) to node rows and token rows of one file per file_id: its texts by doc_id, then text, an empty line between; null texts add nothing."""

    def figures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                found = [None if t is None else Signals(t.split("\n")).pack() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "signals"])

    def trees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        none: tuple = ()
        last, lines, signals = none, StoredLines(), Signals()

        def done() -> Iterator[tuple]:
            if len(lines):
                return tree_rows(last, lines, signals)
            return tree_rows(last, [""], Signals([""]))

        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                for file_id, text, packed in zip(*(batch.column(c).to_pylist() for c in ("file_id", "text", "signals"))):
                    if file_id != last:
                        if last is not none:
                            yield from done()
                        last, lines, signals = file_id, StoredLines(), Signals()
                    if text is not None:
                        lines.add(text)
                        signals.join(Signals.unpack(packed))
        if last is not none:
            yield from done()

    kind = texts.schema["doc_id"].dataType.simpleString()
    marked = texts.select("file_id", "doc_id", "text").mapInArrow(figures, f"file_id string, doc_id {kind}, text string, signals binary")
    ordered = marked.repartition("file_id").sortWithinPartitions("file_id", F.col("doc_id").asc_nulls_last(), "text")
    return ordered.mapInArrow(trees, TREE)


def tree_nodes(trees: DataFrame) -> DataFrame:
    return trees.where("normalized IS NULL").drop("normalized", "position")


def tree_tokens(trees: DataFrame) -> DataFrame:
    """Rows as ``token_occurrences`` has them, one per file, name and position; ``ord`` keeps their order of first appearance."""
    return trees.where("normalized IS NOT NULL").select("file_id", "normalized", "position", "ord")
