"""Identifier tokens of outline nodes, with their header or body position."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from quern.functions.text import IDENTIFIER, MIN_PART
from quern.operators.tree import Node, analyze_lines, preorder

OCCURRENCES = (
    "file_id string, normalized string, text string, position string, block_label string, line_number int, depth int, block_size int, ord int"
)
_TOKEN = re.compile(IDENTIFIER)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ACRONYM = re.compile(r"(?<=[A-Z])(?=[A-Z][a-z])")


def compound_parts(token: str) -> list[str]:
    if "_" in token:
        parts = token.split("_")
    else:
        parts = [p for piece in _CAMEL.split(token) for p in _ACRONYM.split(piece)]
        if len(parts) == 1:
            return []
    return [p for p in parts if len(p) >= MIN_PART]


def distinct_tokens(lines: Iterable[tuple[int, str]]) -> Iterator[tuple[str, str, int]]:
    """(normal form, text, line) by first appearance. A name whose normal form is known adds no parts either."""
    seen: set[str] = set()
    for number, line in lines:
        for token in dict.fromkeys(_TOKEN.findall(line)):
            if token.lower() in seen:
                continue
            for text in (token, *compound_parts(token)):
                if (normal := text.lower()) not in seen:
                    seen.add(normal)
                    yield normal, text, number


def node_tokens(node: Node, lines: list[str]) -> Iterator[tuple[str, str, str, int]]:
    for normal, text, _ in distinct_tokens([(0, node.label)]):
        yield normal, text, "header", node.start_line
    body = ((i + 1, lines[i]) for i in range(node.start_line, min(node.end_line, len(lines))))
    for normal, text, number in distinct_tokens(body):
        yield normal, text, "body", number


def token_occurrences(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """files(file_id, content) to one row per token of a node; parents count the lines of their children again."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in OCCURRENCES.split(", ")]
        for batch in batches:
            rows = []
            for file_id, content in zip(batch["file_id"], batch["content"]):
                lines = (content or "").split("\n")
                found = ((n, t) for *_, n in preorder(analyze_lines(lines, max_depth)) for t in node_tokens(n, lines))
                for k, (n, (normal, text, position, number)) in enumerate(found):
                    rows.append((file_id, normal, text, position, n.label, number, n.depth, n.size, k))
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_id", "content").mapInPandas(run, OCCURRENCES)
