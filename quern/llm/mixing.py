"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source's documents form blocks of BLOCK_CHARS characters. Target weights are whole
numbers of slots: block k of a source of weight p out of P in all is released at floor(k P / p)
and due at ceil((k + 1) P / p), and the slots go to released blocks, earliest deadline
first. After P slots every source is exactly at its weight, so the schedule of
those repeats and a block's slot follows from its number; in between, no source is a whole block off
its weight until some source has run out. Slots of an exhausted source stay empty.

Given weights are taken as the fractions they are written as, and are met exactly if
their common period is at most MAX_PERIOD; else they are rounded to whole slots
of that period, one at least, and the bound holds for the rounded weights. Default weights are whole slots of PERIOD to begin with.
"""

from __future__ import annotations

from fractions import Fraction
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from quern.llm.common import packed, table

BLOCK_CHARS = 65536
PERIOD, MAX_PERIOD = 1000, 20_000
#: More sources than this are joined without a broadcast.
BROADCAST_SOURCES = 100_000
#: Characters of a source whose order one task works out, on average; only their ids and lengths matter there.
RANGE_CHARS = 1 << 28
_BIG = 10**15
_STRIDE = 10**6


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The smallest whole numbers in the proportions of positive weights: ratios within a float's error of a simple fraction are that fraction."""
    exact = {k: Fraction(str(w)) for k, w in weights.items()}
    if not all(w > 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    least = min(exact.values())
    ratios = {k: w / least for k, w in exact.items()}
    simple = {k: r.limit_denominator(PERIOD) for k, r in ratios.items()}
    chosen = {k: simple[k] if abs(simple[k] / r - 1) < Fraction(1, 10**12) else r for k, r in ratios.items()}
    scale = lcm(*(r.denominator for r in chosen.values()))
    return {k: min(int(r * scale), 1 << 62) for k, r in chosen.items()}


def shares(sizes: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD) -> DataFrame:
    """sizes(key, c) to (key, p): the slots of each source in a period.

    By default a source's weight is the root of its characters, in whole slots of ``period``, one at least.
    Sources that ``weights`` leaves out get its smallest weight; no weights at all are equal weights.
    """
    if weights is None:
        x = sizes.select("key", F.greatest(F.floor(F.sqrt("c")), F.lit(1)).cast("long").alias("w"))
    else:
        known = whole_weights(weights) if weights else {"": 1}
        named = F.element_at(F.create_map(*(F.lit(v) for k, n in known.items() for v in (f"={k}", n))), F.col("key"))
        x = sizes.select("key", F.coalesce(named, F.lit(min(known.values()))).cast("long").alias("w"))
    # One row, so its broadcast is bounded.
    x = x.withColumn("w", F.col("w").cast("decimal(38,0)"))
    x = x.join(F.broadcast(x.agg(F.sum("w").alias("all"))))
    part = f"w * {period if weights is None else MAX_PERIOD}"
    if weights is None:
        return x.select("key", F.greatest(F.expr(f"{part} div all"), F.lit(1)).cast("long").alias("p"))
    # Beyond MAX_PERIOD, the slots that whole shares leave go to the largest fractions.
    x = x.withColumns({"q": F.expr(f"{part} div all"), "rest": F.expr(f"{part} % all")})
    x = x.withColumn("k", F.row_number().over(W.orderBy(F.desc("rest"), "key")))
    x = x.join(F.broadcast(x.agg((F.lit(MAX_PERIOD) - F.sum("q")).alias("left"))))
    some = F.greatest(F.col("q") + (F.col("k") <= F.col("left")).cast("int"), F.lit(1))
    return x.select("key", F.when(F.col("all") <= MAX_PERIOD, F.col("w")).otherwise(some).cast("long").alias("p"))


def period_slots(sources: DataFrame) -> DataFrame:
    """sources(key, p) to (key, p, total, j, slot, release, due): the j-th block of a source within one period.

    The schedule is one row of as many entries as the period has slots, made in one fold over them.
    """
    x = sources.agg(F.array_sort(F.collect_list(F.struct("key", "p"))).alias("s"), F.sum("p").alias("total")).where("total IS NOT NULL")
    # acc.k: blocks scheduled so far; acc.out: the source of each slot. The least of (due, source) over released blocks is next.
    fold = F.expr(
        """aggregate(sequence(0L, total - 1), named_struct('k', transform(s, v -> 0L), 'out', cast(array() as array<bigint>)),
        (acc, t) -> transform(array(array_min(zip_with(acc.k, transform(s, (v, i) -> named_struct('p', v.p, 'i', i)), (c, v) -> if((c * total) div v.p <= t AND c < v.p, named_struct('due', ((c + 1) * total + v.p - 1) div v.p, 'i', v.i), null)))),
            least -> named_struct('k', transform(acc.k, (c, i) -> if(i = least.i, c + 1, c)), 'out', concat(acc.out, array(cast(least.i as bigint)))))[0],
        acc -> acc.out)"""
    )
    x = x.select("s", "total", F.posexplode(fold).alias("slot", "i"))
    x = x.select("total", F.col("slot").cast("long").alias("slot"), F.get("s", F.col("i").cast("int")).alias("v")).select("total", "slot", "v.key", "v.p")
    x = x.withColumn("j", (F.row_number().over(W.partitionBy("key").orderBy("slot")) - 1).cast("long"))
    return x.withColumns({"release": F.expr("(j * total) div p"), "due": F.expr("((j + 1) * total + p - 1) div p")})


MIXED = ("mix_block", "mix_slot", "mix_place", "mix_release", "mix_due")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, period: int = PERIOD, block_chars: int = BLOCK_CHARS, chars: Column | None = None) -> DataFrame:
    """docs(doc_id, text, source, ...) with mix_block, mix_slot, mix_place and the block's release and due slots.

    Reading by (mix_slot, mix_place, doc_id) gives the mixture; every row has one
    place, repeated rows one after the other. A null source is a source of its own; null and empty texts have no
    characters and share the place of the next document; a long text stands where its first character does. An empty table gives no rows.
    Columns of any name stay, but those that are added replace columns of their names. A source's documents follow each other by
    the MD5 of their id, so a run of ids doesn't end up together. A source of any size is
    spread over hash ranges, whose sizes add up to offsets. ``chars`` stands in for the length of the text, which docs then needn't have.
    """
    size = F.length(F.coalesce("text", F.lit(""))) if chars is None else chars
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    x = docs.select(packed(docs).alias("row"), F.col("doc_id").alias("id"), _key(F.col("source")).alias("key"), size.cast("long").alias("chars"), md5.alias("md5"))
    sizes = x.groupBy("key").agg(F.sum("chars").alias("c"))
    found = sizes.agg(F.count("*"), F.max("c")).first()
    digits = 3
    while 16**digits * RANGE_CHARS < (found[1] or 0) and digits < 8:
        digits += 1
    x = x.withColumn("range", F.substring("md5", 1, digits))
    before = W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = x.groupBy("key", "range").agg(F.sum("chars").alias("c"))
    offsets = ranges.select("key", "range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    slots = period_slots(shares(sizes, weights, period))
    place = W.partitionBy("key", "range").orderBy("md5", "id", "chars").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("in", F.coalesce(F.sum("chars").over(place), F.lit(0)))
    x = x.join(offsets, ["key", "range"]).withColumn("at", F.col("in") + F.col("before"))
    x = x.withColumns({"mix_block": F.floor(F.col("at") / block_chars), "mix_place": F.col("at") % block_chars})
    # Ranges grow with the table, so only slots are broadcast, and those only of so many sources.
    small = F.broadcast if found[0] <= BROADCAST_SOURCES else lambda d: d
    x = x.join(small(slots.select("key", "p").distinct()), "key").withColumn("j", F.col("mix_block") % F.col("p"))
    x = x.join(small(slots.drop("p")), ["key", "j"])
    turn = F.expr("mix_block div p * total")
    x = x.withColumns({"mix_slot": turn + F.col("slot"), "mix_release": turn + F.col("release"), "mix_due": turn + F.col("due")})
    return x.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in MIXED), *MIXED)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` in reading order, range-partitioned by slot."""
    return mixed.repartitionByRange("mix_slot", "mix_place", "doc_id").sortWithinPartitions("mix_slot", "mix_place", "doc_id")


def op6_mixing(spark, folder: str) -> DataFrame:
    chars = F.length(F.coalesce("text", F.lit(""))).alias("chars")
    return mix(table(spark, folder, "documents").select("doc_id", "source", chars), chars=F.col("chars")).drop("chars")


OP6_SQL = f"""
WITH RECURSIVE x AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, length(coalesce(text, '')) AS chars, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT key, greatest(CAST(floor(sqrt(CAST(sum(chars) AS DOUBLE))) AS BIGINT), 1) AS weight FROM x GROUP BY key),
q AS (SELECT key, greatest({PERIOD} * weight // (SELECT sum(weight) FROM w), 1) AS p FROM w),
p AS (SELECT key, CAST(p AS BIGINT) AS p, row_number() OVER (ORDER BY key) AS i FROM q),
n AS (SELECT CAST(sum(p) AS BIGINT) AS tot FROM p),
e AS (SELECT CAST(0 AS BIGINT) AS t, (SELECT list(CAST(0 AS BIGINT)) FROM p) AS ks, CAST(NULL AS BIGINT) AS pick, (SELECT list(p ORDER BY i) FROM p) AS ps, (SELECT tot FROM n) AS tot
 UNION ALL SELECT t + 1, list_transform(ks, lambda k, m: CASE WHEN m = v % {_STRIDE} THEN k + 1 ELSE k END), v % {_STRIDE}, ps, tot FROM
 (SELECT *, list_min(list_transform(ks, lambda c, m: CASE WHEN (c * tot) // ps[m] <= t AND c < ps[m] THEN ((c + 1) * tot + ps[m] - 1) // ps[m] * {_STRIDE} + m ELSE {_BIG} END)) AS v FROM e WHERE t < tot)),
s AS (SELECT key, p, tot, t - 1 AS slot, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS j FROM e JOIN p ON pick = i),
y AS (SELECT doc_id, source, key, coalesce(sum(chars) OVER (PARTITION BY key ORDER BY h, doc_id, chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x)
SELECT doc_id, source, CAST(pos // {BLOCK_CHARS} AS BIGINT) AS mix_block, CAST(pos // {BLOCK_CHARS} // p * tot + slot AS BIGINT) AS mix_slot, CAST(pos % {BLOCK_CHARS} AS BIGINT) AS mix_place,
CAST(pos // {BLOCK_CHARS} // p * tot + (j * tot) // p AS BIGINT) AS mix_release, CAST(pos // {BLOCK_CHARS} // p * tot + ((j + 1) * tot + p - 1) // p AS BIGINT) AS mix_due
FROM y JOIN s ON y.key = s.key AND (pos // {BLOCK_CHARS}) % p = j
"""
