"""Structural outline of one file, and its Arrow-batched form over a table of files.

The subdivision is a chain of greedy folds over the lines of one file, so it
runs as plain Python per file inside ``mapInPandas``: one row in, one row per
node out, no shuffle. Sums go left to right in line order, so thresholds fall
the same way on every run.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from quern.functions.text import LABEL_CHARS, WS

# Fixed values of the outline's rules.
MIN_REGION = 5
TAB_WIDTH = 4
FINE_WINDOW = 15
NARROW_WINDOW = 5
GRADIENT_SCALE = 0.6
TOP_REGION = 100
MIN_RUN = 3
#: Means over more lines than this come from running sums in extended precision, as their cost would grow with the window.
WIDE_WINDOW = 1000

NODES = (
    "file_id string, node_id int, parent_id int, ord int, tree_depth int, start_line int, end_line int, label string, "
    "label_line int, depth int, entropy double, similarity double, collapsed boolean, sample_line string, pattern string"
)

_NAME = r"[a-zA-Z][A-Za-z0-9_.:\-]*"
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_SELF = re.compile(rf"{WS}*<{_NAME}{_EDGE}[^>]*/>{WS}*\Z")
_CLOSE = re.compile(rf"{WS}*</{_NAME}{WS}*>{WS}*\Z")
_OPEN = re.compile(rf"{WS}*<{_NAME}{_EDGE}[^/]*>{WS}*\Z")
_SEPARATOR = re.compile(r"([=\-*#~_])\1{7,}")
_HEADING = re.compile(rf"(#{{1,6}}){WS}+{WS.replace('[', '[^', 1)}")
_ONLY_CLOSERS = re.compile(rf"(?:[}}\]);,]|{WS})*\Z")
_EDGES = re.compile(rf"^{WS}+|{WS}+\Z")
_COMMENT = ("//", "#", "/*", "*", "<!--")
_FILLED = re.compile(WS.replace("[", "[^", 1))


@dataclass(slots=True)
class Node:
    start_line: int
    end_line: int
    label: str
    label_line: int
    depth: int
    entropy: float
    similarity: float
    collapsed: bool = False
    sample_line: str | None = None
    pattern: str | None = None
    children: list[Node] = field(default_factory=list)

    @property
    def size(self) -> int:
        return self.end_line - self.start_line + 1


@dataclass(slots=True)
class Cut:
    at: int
    score: float
    tag: bool = False
    fixed: bool = False


def shannon_entropy(line: str) -> float:
    bits = 0.0
    for count in Counter(line).values():
        share = count / len(line)
        bits -= share * math.log2(share)
    return bits


def trigrams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def jaccard(a: set[str], b: set[str]) -> float:
    if not a or not b:
        return float(not a and not b)
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def jaccard_similarity(a: str, b: str) -> float:
    return jaccard(trigrams(a), trigrams(b))


def indent_depth(line: str) -> int:
    lead = line[: len(line) - len(line.lstrip(" \t"))]
    return len(lead) + (TAB_WIDTH - 1) * lead.count("\t")


def bracket_delta(line: str) -> int:
    return sum(map(line.count, "{[(")) - sum(map(line.count, "}])"))


def tag_delta(line: str) -> int:
    if _SELF.match(line):
        return 0
    return -1 if _CLOSE.match(line) else int(bool(_OPEN.match(line)))


def trim(line: str) -> str:
    return _EDGES.sub("", line)


def _doubles(x: np.ndarray) -> array:
    return array("d", x.astype(np.float64).tobytes())


def smooth(values: Iterable[float], window: int = NARROW_WINDOW) -> array:
    """Centred mean over window // 2 neighbours on each side, cut off at the ends."""
    half = window // 2
    x = np.array(values, dtype=np.float64)
    at = np.arange(len(x))
    first, last = np.maximum(at - half, 0), np.minimum(at + half + 1, len(x))
    if window > WIDE_WINDOW:
        sums = np.append(np.longdouble(0), np.cumsum(x, dtype=np.longdouble))
        total = (sums[last] - sums[first]).astype(np.float64)
    else:
        total = np.zeros(len(x))
        for k in range(max(-half, 1 - len(x)), 0):
            total[-k:] += x[:k]
        total += x
        for k in range(1, min(half + 1, len(x))):
            total[:-k] += x[k:]
    return _doubles(total / (last - first))


def gradients(values: Iterable[float]) -> list[float]:
    x = np.array(values, dtype=np.float64)
    return np.append(0.0, np.abs(np.diff(x))).tolist() if len(x) else []


def upper_tenth(values: Iterable[float]) -> float:
    x = np.sort(np.array(values, dtype=np.float64))
    return float(x[math.floor(len(x) * 0.9)])


def mean_std(values: list[float]) -> tuple[float, float]:
    """Population mean and deviation; zeros for no values."""
    if not values:
        return 0.0, 0.0
    total = 0.0
    for x in values:
        total += x
    mean = total / len(values)
    squares = 0.0
    for x in values:
        squares += (x - mean) ** 2
    return mean, math.sqrt(squares / len(values))


def default_max_depth(lines: int) -> int:
    if lines < 300:
        return 2
    return 4 if lines <= 2000 else 3 if lines <= 50000 else 2


BLANK, COMMENT, RULE, SHORT = 1, 2, 4, 8


class Signals:
    """Figures of a file's lines in packed arrays; ``similarity`` is that of each line and the next."""

    FIELDS = {"entropy": "d", "similarity": "d", "indent": "i", "brackets": "i", "tags": "b", "heading": "b", "marks": "B"}

    def __init__(self, lines: Iterable[str] = ()):
        for name, kind in self.FIELDS.items():
            setattr(self, name, array(kind))
        before = None
        for x in lines:
            grams = trigrams(x)
            if before is not None:
                self.similarity.append(jaccard(before, grams))
            before = grams
            filled = _FILLED.search(x)
            comment = filled and x.startswith(_COMMENT, filled.start())
            self.marks.append((not filled) * BLANK + bool(comment) * COMMENT + bool(filled and _SEPARATOR.search(x)) * RULE + (not grams) * SHORT)
            self.entropy.append(shannon_entropy(x))
            self.indent.append(indent_depth(x))
            self.brackets.append(bracket_delta(x))
            self.tags.append(tag_delta(x) if "<" in x else 0)
            self.heading.append(len(m[1]) if (m := _HEADING.match(x)) else 0)

    def __len__(self) -> int:
        return len(self.marks)

    def extend(self, other: Signals) -> None:
        for name in self.FIELDS:
            getattr(self, name).extend(getattr(other, name))

    def join(self, other: Signals) -> None:
        """Appends a file's lines after an empty one, whose neighbours are similar to it only if they have no trigram either."""
        if len(self):
            self.similarity.append(float(self.marks[-1] & SHORT > 0))
            self.extend(EMPTY_LINE)
            self.similarity.append(float(other.marks[0] & SHORT > 0))
        self.extend(other)

    def pack(self) -> bytes:
        return len(self).to_bytes(8, "little") + b"".join(getattr(self, name).tobytes() for name in self.FIELDS)

    @classmethod
    def unpack(cls, data: bytes) -> Signals:
        out, n, at = cls(), int.from_bytes(data[:8], "little"), 8
        for name, kind in cls.FIELDS.items():
            x = getattr(out, name)
            end = at + (n - (name == "similarity")) * x.itemsize
            x.frombytes(data[at:end])
            at = end
        return out


EMPTY_LINE = Signals([""])


class StoredLines:
    """Lines of texts that are joined by an empty line, kept in a temporary file of the worker."""

    def __init__(self):
        self.file, self.size, self.starts = tempfile.TemporaryFile(buffering=0), 0, array("q")

    def add(self, text: str) -> None:
        data = text.encode()
        if self.starts:
            self.starts.append(self.size + 1)
            data = b"\n\n" + data
        head = 2 * bool(self.starts)
        self.starts.append(self.size + head)
        ends = np.flatnonzero(np.frombuffer(data, np.uint8)[head:] == 10)
        self.starts.frombytes((ends + (self.size + head + 1)).astype(np.int64).tobytes())
        rest = memoryview(data)
        while rest:
            rest = rest[self.file.write(rest) :]
        self.size += len(data)

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, start: int, end: int) -> str:
        if end <= start:
            return ""
        first, last = self.starts[start], self.starts[end] - 1 if end < len(self.starts) else self.size
        parts = []
        while first < last:
            parts.append(os.pread(self.file.fileno(), last - first, first))
            first += len(parts[-1])
        return b"".join(parts).decode()

    def __getitem__(self, at: int) -> str:
        return self.text(at, at + 1)


def joined(lines: list[str] | StoredLines, start: int, end: int) -> str:
    return lines.text(start, end) if isinstance(lines, StoredLines) else "\n".join(lines[start:end])


def gram_codes(text: str) -> np.ndarray:
    """The distinct trigrams of a text as sorted numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    g = np.sort(c[:-2] | c[1:-1] << 21 | c[2:] << 42)
    return g[np.append(True, g[1:] != g[:-1])] if len(g) else g


def code_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(not len(a) and not len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


class Outline:
    """The tree of one file; ``children`` holds its top nodes."""

    def __init__(self, lines: list[str] | StoredLines, max_depth: int | None = None, signals: Signals | None = None):
        self.lines = lines
        found = Signals(lines) if signals is None else signals
        self.marks, self.entropy, self.indent, self.brackets, self.tags, self.heading = found.marks, found.entropy, found.indent, found.brackets, found.tags, found.heading
        self.next_similarity = found.similarity
        self.blank = array("B", (m & BLANK for m in found.marks))
        self.mean, self.std = mean_std([e for e, b in zip(self.entropy, self.blank) if not b])
        self.max_depth = default_max_depth(len(lines)) if max_depth is None else max_depth
        if len(lines) <= 1:
            self.children = [self.leaf(0, len(lines))] if len(lines) else []
        else:
            self.children = self.divide(0, len(lines), 0)

    def z(self, entropy: float) -> float:
        return (entropy - self.mean) / self.std if self.std > 0.1 else 0.0

    def label(self, start: int, end: int) -> tuple[str, int]:
        first = next((i for i in range(start, end) if not self.blank[i]), None)
        at = next((i for i in range(start, end) if not self.marks[i] & (BLANK | COMMENT)), first)
        return ("(empty)", start) if at is None else (trim(self.lines[at])[:LABEL_CHARS], at)

    def leaf(self, start: int, end: int) -> Node:
        text, at = self.label(start, end)
        first = next((i for i in range(start, end) if not self.blank[i]), None)
        total = 0.0
        for x in self.next_similarity[start : end - 1]:
            total += x
        similarity = total / (end - start - 1) if end - start > 1 else 1.0
        return Node(start + 1, end, text, at + 1, 0 if first is None else self.indent[first], self.mean_entropy(start, end), similarity)

    def mean_entropy(self, start: int, end: int) -> float:
        total = 0.0
        for x in self.entropy[start:end]:
            total += x
        return total / (end - start) if end > start else 0.0

    def divide(self, start: int, end: int, depth: int) -> list[Node]:
        z = self.z(self.mean_entropy(start, end))
        bonus = int(z > 0.5) - int(z < -0.5)
        if bonus < 0 and any(self.heading[start:end]):
            bonus = 0
        if end - start <= MIN_REGION or depth >= self.max_depth + bonus:
            return [self.leaf(start, end)]
        edges = [start, *self.splits(start, end, depth), end]
        parts = [(a, b) for a, b in zip(edges, edges[1:]) if b > a]
        if len(parts) <= 1:
            return [self.leaf(start, end)]
        found: list[Node] = []
        for a, b in parts:
            below = self.divide(a, b, depth + 1)
            if len(below) > 1:
                parent = self.leaf(a, b)
                parent.children = below
                below = [parent]
            found += below
        return absorb_closers(self.collapse(found))

    def splits(self, start: int, end: int, depth: int) -> list[int]:
        cuts = [c for c in self.explicit_cuts(start, end) if start < c.at < end]
        if cuts:
            return [c.at for c in self.within_budget(cuts, start, end, depth)]
        return self.entropy_cuts(start, end) or self.steepest(start, end)

    def within_budget(self, cuts: list[Cut], start: int, end: int, depth: int) -> list[Cut]:
        size = end - start
        target = TOP_REGION if depth == 0 else max(MIN_REGION * 4, TOP_REGION // (depth + 1))
        budget = max(2, size // target)
        if len(cuts) <= budget or size < 200:
            return cuts
        if depth == 0 and size >= 3 * target:
            steps = gradients(smooth(self.entropy[start:end], max(30, size // 20)))
            scale = max(0.01, upper_tenth(steps))
            cuts = [c if c.fixed else Cut(c.at, c.score * (0.3 + 0.7 * min(1.0, steps[c.at - start] / scale)), c.tag) for c in cuts]
        best = sorted(cuts, key=lambda c: -c.score)[:budget]
        return sorted(best, key=lambda c: c.at)

    def candidates(self, start: int, end: int) -> Iterator[Cut]:
        """Cuts that single lines suggest, before any thinning."""
        size = end - start
        steps = gradients(smooth(self.entropy[start:end], FINE_WINDOW)) if size >= 2 * FINE_WINDOW + 1 else [0.0] * size
        tenth = upper_tenth(steps)
        scale = tenth if tenth > 0.01 else GRADIENT_SCALE
        depth = tag_depth = 0
        for k in range(size):
            i = start + k
            before, depth = depth, depth + self.brackets[i]
            tag_before, tag_depth = tag_depth, tag_depth + self.tags[i]
            weight = min(1.0, steps[k] / scale)
            if self.marks[i] & RULE:
                yield Cut(i, 5.0, fixed=True)
                continue
            if level := self.heading[i]:
                yield Cut(i, max(2.5, 5.0 - 0.5 * level) * (0.4 + 0.6 * weight))
                continue
            if self.blank[i]:
                yield Cut(i, 3 * weight)
                continue
            if k and depth <= 0 < before and i + 1 < end:
                yield Cut(i + 1, 2 * (0.5 + 0.5 * min(1.0, steps[k + 1] / GRADIENT_SCALE)))
                continue
            if k and self.tags[i] < 0 and tag_depth < tag_before:
                if i + 1 < end:
                    yield Cut(i + 1, 2 * weight, tag=True)
                continue
            drop = self.indent[i - 1] - self.indent[i] if k else 0
            if drop > 0 and (self.indent[i] == 0 or drop >= 2 * TAB_WIDTH):
                yield Cut(i, weight)

    def explicit_cuts(self, start: int, end: int) -> list[Cut]:
        apart: list[Cut] = []
        for c in sorted(self.candidates(start, end), key=lambda c: c.at):
            if not apart or c.at - apart[-1].at > 2:
                apart.append(c)
            elif c.score > apart[-1].score:
                apart[-1] = c
        if not any(c.tag for c in apart):
            return apart
        kept: list[Cut] = []
        last = start
        for c in apart:
            if not c.tag or c.at - last >= MIN_REGION:
                kept.append(c)
                last = c.at
        if kept and kept[-1].tag and end - kept[-1].at < MIN_REGION:
            kept.pop()
        return kept

    def entropy_cuts(self, start: int, end: int) -> list[int]:
        size = end - start
        window = max(5, min(25, size // 15))
        if size < 3 * MIN_REGION or size < 2 * window + 1:
            return []
        steps = gradients(smooth(self.entropy[start:end], window))
        mean, std = mean_std([self.entropy[i] for i in range(start, end) if not self.blank[i]])
        cv = std / mean if mean > 0 else 0.0
        if cv < 0.15:
            return []
        most = max(1, min(12, math.floor(size / 40 * min(2.0, cv / 0.3))))
        gap = max(MIN_REGION, math.floor(size / (most + 1) / 2))
        peaks: list[int] = []
        for k in sorted((k for k in range(size) if steps[k] > 0), key=lambda k: -steps[k]):
            if len(peaks) == most:
                break
            if all(abs(k - p) >= gap for p in peaks):
                peaks.append(k)
        snapped = {self.near_blank(start + k, start, end) for k in peaks}
        return sorted(i for i in snapped if start + MIN_REGION < i < end - MIN_REGION)

    def near_blank(self, at: int, start: int, end: int) -> int:
        """The closest blank line up to three lines away, the later one first; else the line itself."""
        for i in (at, at + 1, at - 1, at + 2, at - 2, at + 3, at - 3):
            if start < i < end and self.blank[i]:
                return i
        return at

    def steepest(self, start: int, end: int) -> list[int]:
        if end - start < 2 * NARROW_WINDOW + 1:
            return []
        steps = gradients(smooth(self.entropy[start:end]))
        top = max(steps)
        return [start + steps.index(top)] if top >= 0.3 else []

    def grams(self, n: Node) -> np.ndarray:
        return gram_codes(joined(self.lines, n.start_line - 1, n.end_line))

    def collapse(self, nodes: list[Node]) -> list[Node]:
        if len(nodes) < MIN_RUN:
            return nodes
        runs = [[nodes[0]]]
        last: np.ndarray | None = None
        for a, b in zip(nodes, nodes[1:]):
            alike = grams = None
            if min(a.size, b.size) / max(a.size, b.size) >= 0.3:
                bar = max(0.5, min(0.9, 0.7 + self.z((a.entropy + b.entropy) / 2) * 0.1))
                grams = self.grams(b)
                alike = code_jaccard(self.grams(a) if last is None else last, grams) >= bar
            last = grams
            if alike:
                runs[-1].append(b)
            else:
                runs.append([b])
        out: list[Node] = []
        for run in runs:
            if len(run) < MIN_RUN:
                out += run
                continue
            first, count = run[0], f"{len(run)} similar regions"
            lines = run[-1].end_line - first.start_line + 1
            out.append(Node(first.start_line, run[-1].end_line, f"{count} ({lines} lines)", first.label_line, first.depth, first.entropy, 1.0, True, first.label, count))
        return out


def absorb_closers(nodes: list[Node]) -> list[Node]:
    """Short nodes of closing delimiters only become the end of the node before them."""
    out: list[Node] = []
    for n in nodes:
        if out and n.size <= 2 and not n.collapsed and _ONLY_CLOSERS.match(n.label):
            out[-1].end_line = n.end_line
        else:
            out.append(n)
    return out


def analyze_lines(lines: list[str], max_depth: int | None = None) -> list[Node]:
    return Outline(lines, max_depth).children


def preorder(nodes: list[Node]) -> Iterator[tuple[int, int | None, int, int, Node]]:
    """(node_id, parent_id, ord, tree_depth, node), parents first."""
    stack = [(None, k, 1, n) for k, n in reversed(list(enumerate(nodes)))]
    number = 0
    while stack:
        parent, k, depth, n = stack.pop()
        yield number, parent, k, depth, n
        stack += [(number, j, depth + 1, c) for j, c in reversed(list(enumerate(n.children)))]
        number += 1


def outline_nodes(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """files(file_id, content) to one row per node. Null content counts as empty text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            rows = []
            for file_id, content in zip(batch["file_id"], batch["content"]):
                for number, parent, k, depth, n in preorder(analyze_lines((content or "").split("\n"), max_depth)):
                    rows.append((file_id, number, parent, k, depth, n.start_line, n.end_line, n.label, n.label_line, n.depth, n.entropy, n.similarity, n.collapsed, n.sample_line, n.pattern))
            out = pd.DataFrame(rows, columns=names)
            out["parent_id"] = out["parent_id"].astype("Int32")
            yield out

    return files.select("file_id", "content").mapInPandas(run, NODES)
