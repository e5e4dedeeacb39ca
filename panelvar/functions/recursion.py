"""First-order linear recursions s_k = rho_k * s_{k-1} + e_k as windows, without a per-row loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK = 64
#: Maps composed in one level of the scan over blocks, and the row numbers there can be (32 bits).
RADIX, MOST_ROWS = 8, (1 << 31) - 1
_TINY = 1e-4


def _scan(df: DataFrame, series: WindowSpec) -> DataFrame:
    """On the last row of each block, turns the block's map s -> _prod * s + _local into that of all rows so far.

    Each level composes a block's map with those of the RADIX - 1 stretches before it and so makes the
    stretch RADIX times longer: a row's work does not depend on the length of its series, and no level
    divides, so products that vanish are harmless. Beyond the first row stands the identity.
    """
    step = BLOCK
    while step <= MOST_ROWS:
        back = [i for i in range(1, RADIX) if step * i <= MOST_ROWS]
        lags = {f"{c}{i}": F.lag(c, step * i, d).over(series) for i in back for c, d in (("_prod", 1.0), ("_local", 0.0))}
        df = df.withColumns(lags)
        prod, local = F.col(f"_prod{back[-1]}"), F.col(f"_local{back[-1]}")
        for i in reversed(range(back[-1])):
            p, x = F.col(f"_prod{i or ''}"), F.col(f"_local{i or ''}")
            prod, local = p * prod, x + p * local
        df = df.withColumns({"_prod": prod, "_local": local}).drop(*lags)
        step *= RADIX
    return df


def linear_recursion(
    df: DataFrame, by: Sequence[str], order: str, rho: Column | float, inputs: str, out: str
) -> DataFrame:
    """Adds ``out`` for inputs ordered within ``by``; s starts at its first input.

    ``rho`` is a number or a column and may differ by row. Inside a block of 64 rows the recursion is
    a running sum of inputs over the running product of rho, which stays far from overflow. Blocks
    chain through a prefix scan of their maps, level by level, in lags over the same order: work is
    linear in the series and no row gathers a list. All windows keep the ``by`` partitioning, so
    nothing is shuffled again.
    """
    rho = F.lit(float(rho)) if isinstance(rho, (int, float)) else rho
    series = Window.partitionBy(*by).orderBy(order)
    base = df.withColumn("_k", F.row_number().over(series) - 1).withColumns(
        {"_j": F.col("_k") % BLOCK, "_blk": F.floor(F.col("_k") / BLOCK), "_rho": rho}
    )
    inside = Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e, j = F.col(inputs), F.col("_j")
    base = base.withColumn("_prod", F.exp(F.sum(F.log(F.greatest("_rho", F.lit(_TINY)))).over(inside)))
    local = base.withColumn("_local", F.col("_prod") * F.sum(e / F.col("_prod")).over(inside))
    scanned = local.withColumns({"_own": F.col("_prod"), "_part": F.col("_local")})
    scanned = _scan(scanned, series).withColumn("_carry", F.when(j == 0, F.lag("_local", 1, 0.0).over(series)))
    value = F.col("_part") + F.first("_carry").over(inside) * F.col("_own")
    # A decay below 1e-4 is exact to double precision after four terms.
    short, factor = e, F.col("_rho")
    for step in range(1, 5):
        short = short + F.coalesce(F.lag(inputs, step).over(series) * factor, F.lit(0.0))
        factor = factor * F.lag("_rho", step).over(series)
    return scanned.withColumn(out, F.when(F.col("_rho") < _TINY, short).otherwise(value)).drop(
        "_k", "_j", "_blk", "_rho", "_prod", "_local", "_own", "_part", "_carry"
    )


def ewma_variance(returns: DataFrame, decay: float, ret: str = "r", out: str = "ewma_var") -> DataFrame:
    """Exponentially weighted mean square known at each close; starts at the first return squared.

    A row without a return carries the level on and still ages it: after g rows the old level weighs
    decay^g against 1 - decay for the new square. Rows before the first return have no level.
    """
    series = Window.partitionBy("asset").orderBy("trade_date")
    square = F.pow(F.col(ret), 2)
    known = returns.withColumn("_pos", F.row_number().over(series)).where(F.col(ret).isNotNull())
    old = F.pow(F.lit(float(decay)), F.col("_pos") - F.lag("_pos").over(series))
    known = known.select("asset", "trade_date", square.alias("_x"), old.alias("_old"))
    total = F.col("_old") + (1 - decay)
    known = known.select(
        "asset",
        "trade_date",
        F.coalesce((1 - decay) * F.col("_x") / total, F.col("_x")).alias("_e"),
        F.coalesce(F.col("_old") / total, F.lit(1.0)).alias("_keep"),
    )
    path = linear_recursion(known, ["asset"], "trade_date", F.col("_keep"), "_e", "_level").drop("_e", "_keep")
    level = F.last("_level", ignorenulls=True).over(series)
    return returns.join(path, ["asset", "trade_date"], "left").withColumn(out, level).drop("_level")
