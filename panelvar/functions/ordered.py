"""Distributed order statistics: running sums over a total order, and exact quantiles.

A plain window ordered by a score sends one group to one task, and the exact ``percentile`` holds
every distinct value of a group in one buffer. A pooled group can hold most of the data, so both are
done in value buckets: bucket edges come from a mergeable sketch, rows are ordered inside a bucket,
and only one row per bucket travels between buckets. The edges affect balance, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin

BUCKETS = 64


def bucket_edges(df: DataFrame, by: Sequence[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """(by..., edges): increasing inner edges per group, from an approximate quantile sketch.

    Two runs of a sketch may differ, so the small table is pinned before anything joins it.
    """
    cuts = ", ".join(str(i / buckets) for i in range(1, buckets))
    sketch = F.expr(f"array_sort(array_distinct(percentile_approx({value}, array({cuts}), 1000))) AS edges")
    return pin(df.groupBy(*by).agg(sketch))


def running_totals(
    df: DataFrame, by: Sequence[str], value: str, totals: Sequence[str], descending: bool = False, buckets: int = BUCKETS
) -> DataFrame:
    """Adds ``cum_{c}`` for each column: the inclusive running sum over ordered values.

    ``df`` has one row per (by, value). A value's bucket is the number of edges below it.
    """
    by = list(by)
    edges = bucket_edges(df, by, value, buckets)
    # One row per group; left to adaptive execution, which broadcasts it when it is small.
    placed = df.join(edges, by).selectExpr(
        *[f"`{c}`" for c in df.columns], f"size(filter(edges, e -> e < `{value}`)) AS bucket"
    )
    keys, way = ", ".join(by), "DESC" if descending else "ASC"
    inside = placed.selectExpr(
        "*",
        *[
            f"sum({c}) OVER (PARTITION BY {keys}, bucket ORDER BY {value} {way} ROWS UNBOUNDED PRECEDING) AS in_{c}"
            for c in totals
        ],
    )
    before = f"OVER (PARTITION BY {keys} ORDER BY bucket {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = (
        placed.groupBy(*by, "bucket")
        .agg(*[F.sum(c).alias(f"b_{c}") for c in totals])
        .selectExpr(*by, "bucket", *[f"coalesce(sum(b_{c}) {before}, 0) AS o_{c}" for c in totals])
    )
    return inside.join(offsets, [*by, "bucket"]).selectExpr(
        *[f"`{c}`" for c in df.columns], *[f"in_{c} + o_{c} AS cum_{c}" for c in totals]
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    qs: Sequence[float],
    weight: str | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """(by..., q, quantile): linear-interpolation quantiles, exact for groups of any size.

    Values reduce to counts (``weight`` names an existing count), running counts give each value its
    zero-based ranks cum_n - n to cum_n - 1, and a quantile picks the two values whose ranks it needs.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull())
    counts = (
        counts.groupBy(*by, value).agg(F.count("*").alias("n"))
        if weight is None
        else counts.select(*by, value, F.col(weight).alias("n"))
    )
    sizes = counts.groupBy(*by).agg(F.sum("n").alias("size"))
    levels = ", ".join(f"{float(q)}D" for q in qs)
    wanted = (
        f"transform(array({levels}), q -> struct(q AS q, floor(q * (size - 1)) AS low, "
        "least(floor(q * (size - 1)) + 1, size - 1) AS high, q * (size - 1) - floor(q * (size - 1)) AS weight))"
    )
    ranked = running_totals(counts, by, value, ["n"], buckets=buckets).join(sizes, by)
    hit = "filter({w}, t -> t.low BETWEEN cum_n - n AND cum_n - 1 OR t.high BETWEEN cum_n - n AND cum_n - 1)"
    hits = ranked.selectExpr(*by, f"`{value}` AS v", "n", "cum_n", f"explode({hit.format(w=wanted)}) AS t")
    return (
        hits.groupBy(*by, "t.q", "t.weight")
        .agg(
            F.expr("max(CASE WHEN t.low BETWEEN cum_n - n AND cum_n - 1 THEN v END) AS a"),
            F.expr("max(CASE WHEN t.high BETWEEN cum_n - n AND cum_n - 1 THEN v END) AS b"),
        )
        .selectExpr(*by, "q", "a + (b - a) * weight AS quantile")
    )
