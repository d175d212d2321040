"""Mixing sources to target weights by systematic sampling, in Spark functions only.

Sources in code-point order, null last, weigh WEIGHTS, repeated. They share
SHARE of all words in proportion, but no target exceeds CAP times its source;
the excess goes to the others by weight until none is above (a water level).
A row's expected copies are its source's target over its size. Rows of a source
stand in one order; with prefix sums of expected copies and one offset per
source, a row is emitted once per integer boundary that its span crosses.

The order is by buckets of similar size, split by an id hash. A bucket's place
follows from bucket counts (at most some ten thousand a source, whatever its
rows), so only rows of one bucket are sorted together and a hot source is dealt
over many tasks. Neighbours are alike in size, so taken words stay near target.

Results in special cases: a null text has size 0; the null source is a source;
sources without words have target 0 and are not taken; equal rows are
interchangeable; offsets and order derive from md5 of source and id, so reruns
agree; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0
_SALTS = 64


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def _unit(hex_digits: Column) -> Column:
    """Five hex digits as a number from 0 to 1."""
    return F.conv(hex_digits, 16, 10).cast("double") / float(1 << 20)


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target of every source of sized(source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(ranked) - 1) % len(WEIGHTS) + 1)
    cap = F.col("source_size") * CAP
    weighed = sources.withColumn("weight", weight.cast("double")).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy()) * SHARE
    room = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = room / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = weighed.withColumn("level", level)
    # the first source that the level does not fill, by ratio, sets it for all
    fits = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(Window.partitionBy())
    target = F.coalesce(F.least("cap", fits["level"] * F.col("weight")), F.col("cap"))
    return levels.select("source", "source_size", target.alias("target"))


def mix_sources(rows: DataFrame) -> DataFrame:
    """rows(doc_id, source, size, ...) with source_size, target and copies, which
    replace columns of these names."""
    rows = rows.drop("source_size", "target", "copies")
    bucket = ["__lf_source", "__lf_bin", "__lf_salt"]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    dealt = rows.withColumns(
        {
            "__lf_source": key,
            "__lf_hash": digest,
            "__lf_bin": F.floor(F.log(F.col("size") + 1) * 4).cast("int"),
            "__lf_salt": F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(_SALTS)),
        }
    )
    before = Window.partitionBy("__lf_source").orderBy("__lf_bin", "__lf_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*bucket).agg(F.count("*").alias("n")).withColumn("__lf_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    offset = _unit(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("__lf_source")).cast("binary")), 1, 5))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(rows).select(key.alias("__lf_source"), "source_size", "target", rate.alias("__lf_rate"), offset.alias("__lf_offset"))
    place = F.col("__lf_before") + F.row_number().over(Window.partitionBy(*bucket).orderBy("size", "__lf_hash", "doc_id"))
    crossed = F.floor(F.col("__lf_place") * F.col("__lf_rate") + F.col("__lf_offset")) - F.floor((F.col("__lf_place") - 1) * F.col("__lf_rate") + F.col("__lf_offset"))
    return (
        dealt.join(starts.join(targets, "__lf_source"), bucket)
        .withColumn("__lf_place", place)
        .withColumn("copies", crossed.cast("long"))
        .select(*rows.columns, "source_size", "target", "copies")
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix takes it."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__lf_row"))
    taken = mix_sources(rows).filter("copies > 0")
    return taken.withColumn("__lf_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__lf_row.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
              [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                   - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT source, source_size,
              coalesce(least(cap, arg_min(level, cap / weight) FILTER (level <= cap / weight) OVER () * weight), cap) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
              CAST('0x' || substr(md5('mix:' || coalesce('s' || source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS u FROM s3),
p AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY floor(ln(size + 1) * 4), CAST('0x' || substr(h, 1, 4) AS BIGINT) % 64, size, h, doc_id) AS i FROM d)
SELECT p.doc_id, p.size, s4.source_size, s4.target,
       CAST(p.size * (floor(i * rate + u) - floor((i - 1) * rate + u)) AS BIGINT) AS taken
FROM p JOIN s4 ON p.source IS NOT DISTINCT FROM s4.source
"""
