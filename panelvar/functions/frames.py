"""Window frames and guarded math shared by the operators.

A window partition is one asset's daily history. The load keeps (asset, date) unique, so a partition
holds at most one row per trading day, however many assets or raw rows the panel has.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_asset(order: str = "trade_date", *extra: str) -> WindowSpec:
    return Window.partitionBy("asset", *extra).orderBy(order)


def trailing(spec: WindowSpec, n: int) -> WindowSpec:
    return spec.rowsBetween(-(n - 1), 0)


def full(col: Column, agg: Column, frame: WindowSpec, n: int) -> Column:
    """``agg`` over ``frame``, only where all ``n`` rows of the frame carry a value."""
    return F.when(F.count(col).over(frame) == n, agg.over(frame))


def ln(col: Column) -> Column:
    """Logarithm of positive values, NULL elsewhere."""
    return F.when(col > 0, F.log(col))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def clip(col: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip that keeps NULL (``greatest``/``least`` alone would skip it)."""
    out = col
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(col.isNotNull(), out)


def finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) < F.lit(float("inf"))), col)


def rounded(col: Column, digits: int = 8) -> Column:
    """Rounded value without a negative zero."""
    value = F.round(col, digits)
    return F.when(value == 0, F.lit(0.0)).otherwise(value)


def sorted_quantile(ordered: Column, q: Column | float) -> Column:
    """Linear-interpolation quantile of an ascending array (NULL for an empty one)."""
    q = F.lit(q) if isinstance(q, float) else q
    n = F.size(ordered)
    pos = q * (n - 1)
    low = F.floor(pos).cast("int")
    a = F.get(ordered, low)
    b = F.get(ordered, F.least(low + 1, n - 1))
    return F.when(n > 0, a + (b - a) * (pos - low))


def mean_at_most(ordered: Column, cut: Column) -> Column:
    """Mean of the array elements that do not exceed ``cut``."""
    kept = F.filter(ordered, lambda x: x <= cut)
    return ratio(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x), F.size(kept).cast("double"))


def compounded(r: Column) -> Column:
    """Aggregate: total return of daily simple returns."""
    return F.product(F.lit(1.0) + r) - F.lit(1.0)
