"""Scalar line functions as Catalyst expressions.

Every function takes and returns a Column. String positions are code points,
so results equal a UTF-16 engine's on BMP text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ECMAScript has it, and an ASCII word boundary.
WS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NOT_WS = WS.replace("[", "[^", 1)
ASCII_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
IDENTIFIER = "[a-zA-Z_$][a-zA-Z0-9_$]{2,}"
SEPARATOR = r"([=\-*#~_])\1{7,}"
HEADING = rf"^(#{{1,6}}){WS}+{NOT_WS}"
TAB_WIDTH = 4
LABEL_CHARS = 80
MIN_PART = 3
GRADIENT_SCALE = 0.6


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, rf"^{WS}+|{WS}+\z", "")


def is_blank(line: Column) -> Column:
    return F.length(trimmed(line)) == 0


def newline_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))


def shannon_entropy(line: Column) -> Column:
    """Bits per character; 0 for an empty line."""
    n = F.length(line)
    # Equal characters stand together in sorted order, so each run is one of them.
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(line, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    bits = F.aggregate(F.transform(runs, lambda r: F.length(r) / n), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def trigrams(line: Column) -> Column:
    grams = F.transform(F.sequence(F.lit(1), F.length(line) - 2), lambda i: F.substring(line, i, F.lit(3)))
    return F.when(F.length(line) >= 3, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two trigram sets: two empty sets are equal, one empty set shares nothing."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )


def jaccard_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def indent_depth(line: Column) -> Column:
    lead = F.regexp_extract(line, "^[ \t]*", 0)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    return F.length(lead) + (TAB_WIDTH - 1) * tabs


def bracket_delta(line: Column) -> Column:
    kept = lambda pattern: F.length(F.regexp_replace(line, pattern, ""))
    return kept(r"[^{\[(]") - kept(r"[^}\])]")


_TAG = {
    "self": rf"^{WS}*<[a-zA-Z][a-zA-Z0-9_.:\-]*{ASCII_BOUNDARY}[^>]*/>{WS}*\z",
    "close": rf"^{WS}*</[a-zA-Z][a-zA-Z0-9_.:\-]*{WS}*>{WS}*\z",
    "open": rf"^{WS}*<[a-zA-Z][a-zA-Z0-9_.:\-]*{ASCII_BOUNDARY}[^/]*>{WS}*\z",
}


def tag_delta(line: Column) -> Column:
    """+1, -1 or 0 for a line that is one opening, closing or other tag."""
    return (
        F.when(line.rlike(_TAG["self"]), 0)
        .when(line.rlike(_TAG["close"]), -1)
        .when(line.rlike(_TAG["open"]), 1)
        .otherwise(0)
    )


def is_separator(line: Column) -> Column:
    return ~is_blank(line) & line.rlike(SEPARATOR)


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, 0 for any other."""
    return F.length(F.regexp_extract(line, HEADING, 1))


def heading_ceiling(level: Column) -> Column:
    return F.greatest(F.lit(2.5), F.lit(5.0) - level * 0.5)


def is_comment(line: Column) -> Column:
    t = trimmed(line)
    return t.startswith("//") | t.startswith("#") | t.startswith("/*") | t.startswith("*") | t.startswith("<!--")


def label_text(line: Column) -> Column:
    return F.substring(trimmed(line), 1, LABEL_CHARS)


def is_closing_label(label: Column) -> Column:
    return label.rlike(rf"^(?:[}}\]);,]|{WS})*\z")


def identifiers(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(IDENTIFIER), F.lit(0))


def compound_parts(token: Column) -> Column:
    """Parts of a snake_case or CamelCase name of three characters at least; none for a plain name."""
    long_enough = lambda parts: F.filter(parts, lambda p: F.length(p) >= MIN_PART)
    cut = F.regexp_replace(token, "([a-z])([A-Z])", "$1\u0000$2")
    camel = F.split(F.regexp_replace(cut, "([A-Z]+)([A-Z][a-z])", "$1\u0000$2"), "\u0000")
    return (
        F.when(F.contains(token, F.lit("_")), long_enough(F.split(token, "_")))
        .when(F.size(camel) > 1, long_enough(camel))
        .otherwise(F.array().cast("array<string>"))
    )


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def mtime_seconds(mtime_ms: Column) -> Column:
    return F.floor(mtime_ms / 1000)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def direction_arrow(direction: Column) -> Column:
    return F.when(direction == "outgoing", "→").when(direction == "incoming", "←").when(direction == "bidirectional", "↔")


def idf(total: Column, df: Column) -> Column:
    return F.log2(total / df)


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0.1, (x - mean) / std).otherwise(0.0)


def depth_bonus(z: Column, has_heading: Column) -> Column:
    return F.when(z > 0.5, 1).when((z < -0.5) & ~has_heading, -1).otherwise(0)


def collapse_threshold(z: Column) -> Column:
    return F.greatest(F.lit(0.5), F.least(F.lit(0.9), 0.7 + 0.1 * z))


def size_ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


def default_max_depth(lines: Column) -> Column:
    return F.when(lines < 300, 2).when(lines <= 2000, 4).when(lines <= 50000, 3).otherwise(2)


def target_size(depth: Column) -> Column:
    return F.when(depth == 0, 100).otherwise(F.greatest(F.lit(20), F.floor(F.lit(100) / (depth + 1)).cast("int")))


def boundary_budget(length: Column, depth: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(length / target_size(depth)).cast("int"))


def entropy_factor(gradient: Column, scale: Column) -> Column:
    return F.least(F.lit(1.0), gradient / scale)


def normalise_path(path: Column) -> Column:
    """A drive-letter path out of /c/...; opt-in, since it also rewrites real one-letter folders."""
    form = "^/([a-zA-Z])/(.*)"
    rest = F.replace(F.regexp_extract(path, form, 2), F.lit("/"), F.lit("\\"))
    return F.when(path.rlike(form), F.concat(F.upper(F.regexp_extract(path, form, 1)), F.lit(":\\"), rest)).otherwise(path)


def is_numeric_offset(offset: Column) -> Column:
    return F.coalesce(offset.rlike(r"^[0-9]+\z"), F.lit(False))


def log_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def log_value(value: Column) -> Column:
    """A logged shell value as JSON text: digits and booleans bare, the rest quoted."""
    quoted = F.to_json(F.array(value))
    bare = value.rlike(r"^(?:[0-9]+|true|false)\z")
    return F.when(bare, value).otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2))
