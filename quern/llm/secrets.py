"""Secret scan: fixed patterns, and a randomness test battery over other key-like strings. DataFrame functions only.

A candidate is a run of key characters. Its encoding is the smallest alphabet that
holds it. Under that alphabet, three tests ask whether it could be drawn uniformly
at random: chi-squared over its symbols, a runs test above and below the middle,
and the serial correlation of neighbours; Fisher's method combines them. Random
strings have uniform p-values, so within a class of encoding and length the ones
above one half tell how many there are, and the cut is the lowest p at which the
estimated share of other strings among those kept is within FALSE_RATE. Short
strings, which the tests tell apart badly, so get a stricter cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from quern.llm.common import table

# The base patterns, their kinds in order, and the least length of what they must catch.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_RATE = 0.05
BINS = 20
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Smallest first; a string's encoding is the first that holds all of it.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "alnum": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}


def match_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans (start, kind, end) of leftmost non-overlapping matches, in code points, whose group is long enough.

    The pieces between matches and the matches themselves alternate, so their lengths add up to positions.
    """
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit")))
    if group:
        sizes = F.zip_with(sizes, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x, g: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), (F.length(g) >= least).alias("ok")))
    else:
        sizes = F.transform(sizes, lambda x: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.lit(True).alias("ok")))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["hit"]).alias("stop"))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def upper_tail(z: Column) -> Column:
    """1 - normal distribution function, by a rational approximation good to 1e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    half = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def let(value: Column, body) -> Column:
    """body(value), value being worked out once."""
    return F.transform(F.array(value), body)[0]


def encoding(token: Column) -> Column:
    out = F.lit(None).cast("struct<enc:string,letters:string>")
    for name, alphabet in reversed(ALPHABETS.items()):
        out = F.when(F.translate(token, alphabet, "") == "", F.struct(F.lit(name).alias("enc"), F.lit(alphabet).alias("letters"))).otherwise(out)
    return out


def _neighbours(x: Column) -> Column:
    n = F.size(x)
    return F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda u, v: F.struct(u.alias("u"), v.alias("v")))


def chi_squared_p(x: Column, a: Column) -> Column:
    """Upper tail only: symbols spread too evenly are no sign of text. Wilson and Hilferty's cube root gives the tail."""
    n = F.size(x)
    squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, v: s + F.pow(F.size(F.filter(x, lambda y: y == v)).cast("double"), F.lit(2.0)))
    z = lambda chi: (F.pow(F.greatest(chi, F.lit(0.0)) / (a - 1), F.lit(1 / 3)) - (1 - 2 / (9 * (a - 1)))) / F.sqrt(2 / (9 * (a - 1)))
    return let(z(squares * a / n - n), upper_tail)


def runs_p(high: Column) -> Column:
    """Runs of symbols in the upper and lower half of the alphabet; zero if all are in one."""
    n = F.size(high)
    ups = F.aggregate(high, F.lit(0.0), lambda s, v: s + v)
    runs = F.aggregate(_neighbours(high), F.lit(1.0), lambda s, q: s + (q["u"] != q["v"]).cast("int"))
    mean = let(ups, lambda u: 2 * u * (n - u) / n + 1)

    def tail(mu):
        var = (mu - 1) * (mu - 2) / (n - 1)
        return F.when(var > 0, 2 * let(F.abs(runs - mu) / F.sqrt(var), upper_tail)).otherwise(0.0)

    return let(mean, tail)


def serial_p(x: Column) -> Column:
    """Correlation of neighbours, whose mean is -1/n; zero if all symbols are equal."""
    n = F.size(x)

    def tail(m):
        spread = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m) * (v - m))
        along = F.aggregate(_neighbours(x), F.lit(0.0), lambda s, q: s + (q["u"] - m) * (q["v"] - m))
        return let(spread, lambda d: F.when(d > 0, 2 * let(F.abs(along / d + 1 / n) * F.sqrt(n), upper_tail)).otherwise(0.0))

    return let(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n, tail)


def battery(token: Column) -> Column:
    """(enc, p) of a token: p is Fisher's combination under its encoding."""

    def scored(e):
        body = F.rtrim(token, F.lit("="))
        a = F.length(e["letters"])
        x = F.transform(F.split(body, ""), lambda ch: F.call_function("instr", e["letters"], ch))

        def combined(v):
            half = F.lit(0.0)
            for p in (chi_squared_p(v, a), runs_p(F.transform(v, lambda y: (2 * y > a).cast("int"))), serial_p(v)):
                half = half - F.log(F.greatest(p, F.lit(1e-12)))
            return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

        return F.struct(e["enc"].alias("enc"), let(x, combined).alias("p"))

    return let(encoding(F.rtrim(token, F.lit("="))), scored)


def length_class(token: Column) -> Column:
    """4 for 16 to 31 characters, 5 for 32 to 63, and so on; one class from 1024 on."""
    return F.least(F.floor(F.log2(F.length(token).cast("double"))), F.lit(10)).cast("int")


def scored_candidates(text: Column) -> Column:
    """Spans of candidates with enc, size_class and p."""

    def one(s):
        token = F.substring(text, s["start"] + 1, s["stop"] - s["start"])
        return let(battery(token), lambda b: F.struct(s.alias("span"), b["enc"].alias("enc"), length_class(token).alias("size_class"), b["p"].alias("p")))

    return F.transform(match_spans(text, CANDIDATE, KINDS.index("random")), one)


def cuts(scored: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """scored(enc, size_class, p) to (enc, size_class, cut): the lowest p kept in each class; classes that keep nothing are left out."""
    bins = scored.groupBy("enc", "size_class", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    upward = W.partitionBy("enc", "size_class").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("enc", "size_class")
    x = bins.withColumns({"kept": F.sum("n").over(upward), "random": 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(whole)})
    others = F.greatest(F.col("kept") - F.col("random") * (1 - F.col("bin") / BINS), F.lit(0.0))
    fine = x.where((F.col("random") > 0) & (others / F.col("kept") <= rate))
    return fine.groupBy("enc", "size_class").agg((F.min("bin") / BINS).alias("cut"))


def find_secrets(docs: DataFrame, rate: float = FALSE_RATE) -> DataFrame:
    """docs with _base and _all: arrays of (start, kind, stop) in code points, end exclusive, sorted.

    Null text counts as empty and has no spans; an empty table gives no rows;
    repeated rows are scanned alike. All that comes to the driver are the cuts, one
    per encoding and length class, so at most 12 x 7 rows.
    """
    text = F.coalesce("text", F.lit(""))
    scored = docs.select(F.explode(scored_candidates(text)).alias("c")).select("c.enc", "c.size_class", "c.p")
    chosen = cuts(scored, rate).collect()

    def kept(c):
        ok = F.lit(False)
        for r in chosen:
            ok = ok | ((c["enc"] == r["enc"]) & (c["size_class"] == r["size_class"]) & (c["p"] >= r["cut"]))
        return ok

    base = F.array_sort(F.concat(match_spans(text, ASSIGN, 0, 2, LEAST_VALUE), match_spans(text, ACCESS, 1), match_spans(text, HEX, 2)))
    random = F.transform(F.filter(scored_candidates(text), kept), lambda c: c["span"])
    return docs.withColumns({"_base": base, "_all": F.array_sort(F.concat(base, random))})


def as_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of text replaced by a mark; overlapping spans share one."""
    found = find_secrets(docs)

    def step(acc, s):
        gap = F.substring("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text")))
    clean = F.aggregate("_all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    return found.withColumn("text", F.when(F.size("_all") > 0, clean).otherwise(F.col("text"))).select(docs.columns)


def op4_secrets(spark, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2(as_text(F.col("_base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("_all")).alias("spans"))
