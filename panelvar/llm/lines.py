"""Line dedup by site-relative frequency.

A line is boilerplate of a host if more than a given share of the host's pages hold it. Pages with
the same text count once, on both sides of the ratio, so that copies of one page don't turn its
lines into boilerplate; copies are the business of near-dedup. At most (lines of a page) / ratio
lines of a host can exceed the ratio, so the list of a host is bounded by the length of its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelvar.llm.shared import SPACE, Scratch

#: Share of a host's pages beyond which a line is boilerplate, and the least number of such pages.
RATIO_PERCENT = 10
LEAST_PAGES = 5
#: Rows of the list of all hosts up to which it is sent to every task; beyond, both sides are shuffled.
BROADCAST_HOSTS = 200_000


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(SPACE)))


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: int = RATIO_PERCENT, least: int = LEAST_PAGES) -> DataFrame:
    """doc (all columns, text without boilerplate lines), n_lines, n_dropped.

    Lines are what newlines separate; lines that differ in outer white space are one; blank lines
    stay. Null is a host of its own; null text has no lines and stays null; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    body = F.col(text)
    rows = docs.select(F.struct("*").alias("doc"), F.col(host).cast("string").alias("host"), F.split(body, "\n").alias("lines"))
    inked = F.filter("lines", lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    keys = F.array_distinct(F.transform(inked, _key))
    seen = docs.select(F.col(host).cast("string").alias("host"), F.xxhash64(body).alias("page"), F.split(body, "\n").alias("lines"))
    seen = seen.where("lines IS NOT NULL").select("host", "page", keys.alias("keys"))
    # Each content of a host once: a line's pages are its distinct contents.
    contents = seen.select("host", "page").distinct().groupBy(F.col("host").alias("h")).agg(F.count("*").alias("pages"))
    lines = seen.select("host", F.explode("keys").alias("key"), "page")
    # Most lines stand on one page; a line needs several rows before its distinct pages are counted.
    often = lines.groupBy("host", "key").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    often = scratch.save(
        often.join(contents, F.col("host").eqNullSafe(F.col("h"))).where(F.col("rows") * 100 > F.col("pages") * ratio)
        .select("h", F.col("key").alias("k"), "pages"),
    )
    small = often.count() <= BROADCAST_HOSTS
    named = F.broadcast(often) if small else often
    distinct = (
        lines.join(named, (F.col("key") == F.col("k")) & F.col("host").eqNullSafe(F.col("h")))
        .select("host", "key", "page", "pages").distinct()
        .groupBy("host", "key", "pages").agg(F.count("*").alias("on"))
        .where((F.col("on") >= least) & (F.col("on") * 100 > F.col("pages") * ratio))
        .groupBy(F.col("host").alias("h")).agg(F.collect_list("key").alias("bad"))
    )
    bad = scratch.save(distinct)
    bad = F.broadcast(bad) if small else bad
    rows = rows.join(bad, F.col("host").eqNullSafe(F.col("h")), "left")
    kept = F.filter("lines", lambda x: F.col("bad").isNull() | (F.length(F.btrim(x, F.lit(SPACE))) == 0) | ~F.array_contains(F.col("bad"), _key(x)))
    rows = rows.select("doc", "lines", F.when(F.col("bad").isNull(), F.col("lines")).otherwise(kept).alias("kept"))
    n, m = (F.coalesce(F.size(c), F.lit(0)).cast("bigint") for c in ("lines", "kept"))
    n = F.when(F.col("lines").isNull(), 0).otherwise(n)
    m = F.when(F.col("lines").isNull(), 0).otherwise(m)
    fields = [F.col(f"doc.`{c}`").alias(c) if c != text else F.array_join("kept", "\n").alias(c) for c in docs.columns]
    return rows.select(F.struct(*fields).alias("doc"), n.alias("n_lines"), (n - m).alias("n_dropped"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = drop_lines(docs)
    return out.select("doc.doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("text_md5"))


_TRIMMED = "trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents
), pages AS (
  SELECT source, count(DISTINCT text) AS pages FROM d WHERE text IS NOT NULL GROUP BY source
), l AS (
  SELECT source, text, unnest(ls) AS l FROM (SELECT DISTINCT source, text, ls FROM d WHERE text IS NOT NULL)
), bad AS (
  SELECT b.source, b.l, true AS bad FROM (
    SELECT source, {_TRIMMED} AS l, count(DISTINCT text) AS n FROM l GROUP BY ALL) b
  JOIN pages p ON p.source IS NOT DISTINCT FROM b.source
  WHERE b.l <> '' AND n >= {LEAST_PAGES} AND n * 100 > pages * {RATIO_PERCENT}
), e AS (
  SELECT r, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM d WHERE text IS NOT NULL
), k AS (
  SELECT e.r, count(*) AS n, count(bad.bad) AS dropped, string_agg(e.l, chr(10) ORDER BY i) FILTER (WHERE bad.bad IS NULL) AS body
  FROM e LEFT JOIN bad ON bad.source IS NOT DISTINCT FROM e.source AND bad.l = {_TRIMMED.replace("(l,", "(e.l,")}
  GROUP BY e.r
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(dropped, 0) AS BIGINT) AS n_dropped, md5(coalesce(body, '')) AS text_md5
FROM d LEFT JOIN k USING (r)
"""
