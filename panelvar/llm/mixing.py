"""Mixing sources to target weights by hash thresholds, without sorting documents.

Each document has a fixed number from a hash of its id. A source takes every document so many whole
times, and once more those whose number is at most the source's threshold. The threshold comes from
histograms: words are summed by source and bucket of the number, the bucket that the budget ends in
is cut into finer buckets, and so on; only documents of that bucket are summed again. Sums are
combined before the shuffle, so a source that holds most of the corpus costs no more than another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch, word_count

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_TIMES = 2
#: Bits of the number that one histogram resolves, and bits in all.
STEP_BITS, ALL_BITS = 10, 60
#: Sources, one row each: so many are broadcast at most, and so many are written by one task.
FEW_SOURCES = 100_000


def number(doc_id: Column, size: Column) -> Column:
    """60 bits of a hash; rows alike in id and size share it and are taken or left together."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, ALL_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: int = SHARE_PERCENT, times: int = MOST_TIMES) -> DataFrame:
    """source, source_size, target: one row per source, weights dealt in code-point order, null last.

    A target stops at ``times`` its source's size and the rest is reshared by weight. With sources
    in the order of size by weight, a source is stopped exactly if it would be with all before it
    stopped; so one running sum over the sources (one row each) replaces repeated resharing.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (place % len(weights) + 1).cast("int")).cast("bigint")
    per = per.withColumn("weight", weight)
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.asc_nulls_last("source"))
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    per = per.select(
        "*",
        F.sum("source_size").over(every).alias("all_size"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)).alias("weight_left"),
        F.coalesce(F.sum("source_size").over(before), zero).alias("size_before"),
    )
    room = F.lit(share) * F.col("all_size") - F.lit(100 * times) * F.col("size_before")
    per = per.select("*", room.alias("room"), (F.lit(100 * times) * F.col("source_size") * F.col("weight_left") < room * F.col("weight")).alias("stopped"))
    # The level is that of the first source which isn't stopped.
    first = F.min(F.when(~F.col("stopped"), F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "room", "weight_left"))).over(every)
    per = per.withColumn("first", first)
    level = (F.col("first.room") * F.col("weight")).cast("double") / (F.col("first.weight_left") * 100).cast("double")
    capped = (F.col("source_size") * times).cast("double")
    return per.select("source", "source_size", F.when(F.col("stopped") | (F.col("source_size") == 0), capped).otherwise(level).alias("target"))


def thresholds(sizes: DataFrame, scratch: Scratch, **how) -> DataFrame:
    """source, source_size, target, whole (times that all is taken), cut (numbers up to it: once more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    state = targets(sizes, **how).select("*", whole.alias("whole"))
    state = state.select(
        "*",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("bigint").alias("prefix"),
        F.lit(True).alias("open"),
        F.lit(-1).cast("bigint").alias("cut"),
    )
    state = scratch.save(state)
    n_sources = state.count()
    # One row per source needs few files, whatever the session's shuffle partitions: each costs a write task.
    n_files = max(1, math.ceil(n_sources / FEW_SOURCES))
    for used in range(STEP_BITS, ALL_BITS + 1, STEP_BITS):
        left = ALL_BITS - used
        bucket = F.shiftright("number", left)
        inside = (
            sizes.select(F.col("source").alias("s"), "size", "number")
            .join(F.broadcast(state.where("open")) if n_sources < FEW_SOURCES else state.where("open"), F.col("s").eqNullSafe(F.col("source")))
            .where(F.shiftright(bucket, STEP_BITS) == F.col("prefix"))
            .groupBy("s", "budget", bucket.alias("bucket"))
            .agg(F.sum("size").alias("words"), F.max("number").alias("last"), F.min("number").alias("one"))
        )
        upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        inside = inside.withColumn("before", upto - F.col("words"))
        ends = (
            inside.where(F.col("before") <= F.col("budget"))
            .groupBy("s")
            .agg(F.max_by(F.struct("bucket", "before", "words", "one", "last"), "bucket").alias("end"))
        )
        joined = state.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
        single = (F.col("end.one") == F.col("end.last")) | F.lit(left == 0)
        rest = F.col("budget") - F.col("end.before")
        # All of the bucket fits: its last number. A single number: whichever end is nearer.
        fits = F.col("end.words") <= rest
        near = 2 * rest >= F.col("end.words")
        cut = (
            F.when(~F.col("open") | F.col("end").isNull(), F.col("cut"))
            .when(fits, F.col("end.last"))
            .when(single, F.when(near, F.col("end.one")).otherwise(F.col("end.one") - 1))
            .otherwise(F.col("cut"))
        )
        state = scratch.save(
            joined.select(
                "source", "source_size", "target", "whole",
                F.when(F.col("open") & F.col("end").isNotNull(), rest).otherwise(F.col("budget")).alias("budget"),
                F.when(F.col("open") & F.col("end").isNotNull(), F.col("end.bucket")).otherwise(F.col("prefix")).alias("prefix"),
                (F.col("open") & F.col("end").isNotNull() & ~fits & ~single).alias("open"),
                cut.alias("cut"),
            ).repartition(n_files),
        )
        if state.where("open").isEmpty():
            break
    return state.select("source", "source_size", "target", "whole", "cut")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """Per document: doc (all its columns), size, source_size, target, taken, times.

    ``times`` is how often the mix takes the document, whole each time. Null text has size 0; null
    is a source of its own, the last; rows alike in id and size are taken alike; an empty table
    gives an empty one. Columns of ``docs`` stay inside ``doc``, so none can clash.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    size = word_count(F.col(text))
    rows = docs.select(F.struct("*").alias("doc"), F.col(source).cast("string").alias("source"), size.alias("size"), F.col(doc_id).alias("id"))
    rows = rows.select("doc", "source", "size", number(F.col("id"), F.col("size")).alias("number"))
    sizes = scratch.save(rows.select("source", "size", "number"))
    plan = thresholds(sizes, scratch, **how).withColumnRenamed("source", "plan_source")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    times = F.col("whole") + (F.col("number") <= F.col("cut")).cast("bigint")
    return rows.select("doc", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc.doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), n AS (
  SELECT *, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || CAST(size AS VARCHAR)), 1, 15))::BIGINT AS number FROM d
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM p
), o AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS s_all,
    CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS w_left,
    CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) AS s_before
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (
  SELECT *, 150 * s_all - 200 * s_before AS room, 200 * source_size * w_left < (150 * s_all - 200 * s_before) * weight AS stopped FROM o
), f AS (
  SELECT room AS f_room, w_left AS f_left FROM c WHERE NOT stopped ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size,
    CASE WHEN stopped OR source_size = 0 THEN CAST(2 * source_size AS DOUBLE)
      ELSE CAST(f_room * weight AS DOUBLE) / CAST(f_left * 100 AS DOUBLE) END AS target
  FROM c LEFT JOIN f ON true
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), g AS (
  SELECT source, number, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY number) AS upto FROM n GROUP BY source, number
)
SELECT n.doc_id, n.size, u.source_size, u.target,
  CAST(n.size * (u.whole + CASE WHEN 2 * g.upto - g.words <= 2 * (u.target - u.whole * u.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN u ON n.source IS NOT DISTINCT FROM u.source
JOIN g ON g.source IS NOT DISTINCT FROM n.source AND g.number = n.number
"""
