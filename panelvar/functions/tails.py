"""Distribution constants for fixed arguments, and vectorised tail probabilities for columns."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_multipliers(conf: float) -> tuple[float, float]:
    """(VaR, ES) multiples of sigma for a standard normal shock."""
    z = _NORMAL.inv_cdf(conf)
    return z, _NORMAL.pdf(z) / (1.0 - conf)


def _t_pdf(x: float, df: float) -> float:
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    return c * (1 + x * x / df) ** (-(df + 1) / 2)


def t_tail(x: np.ndarray, df: np.ndarray, nodes: int = 100) -> np.ndarray:
    """P(T > x) for x >= 0, by Gauss-Legendre quadrature in the angle atan(x / sqrt(df))."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    u, w = np.polynomial.legendre.leggauss(nodes)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    const = np.exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / math.sqrt(math.pi)
    low = np.arctan(x / np.sqrt(df))
    half = (np.minimum(np.pi / 2, low + 12 / np.sqrt(df)) - low) / 2
    angle = low[..., None] + half[..., None] * (u + 1)
    return const * half * (np.cos(angle) ** (df[..., None] - 1) * w).sum(axis=-1)


def t_quantile(conf: float, df: float) -> float:
    """Quantile above the median by bisection on the tail."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        if float(t_tail(np.array([mid]), np.array([df]))[0]) > 1.0 - conf:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def student_multipliers(conf: float, df: float) -> tuple[float, float]:
    """(VaR, ES) multiples of sigma for a Student-t shock scaled to unit variance."""
    q = t_quantile(conf, df)
    unit = math.sqrt(df / (df - 2))
    tail_mean = _t_pdf(q, df) / (1.0 - conf) * (df + q * q) / (df - 1)
    return q / unit, tail_mean / unit


@F.pandas_udf(DoubleType())
def _chi2_1_sf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(v / 2)), na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def _t_two_sided(stat: pd.Series, df: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=stat.index)
    ok = stat.notna() & df.notna() & (df > 0)
    if ok.any():
        out[ok] = 2.0 * t_tail(stat[ok].abs().to_numpy(), df[ok].to_numpy())
    return out


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of a chi-square with one or two degrees of freedom."""
    if df == 2:
        return F.exp(-x / 2)
    return F.nanvl(_chi2_1_sf(x), F.lit(None).cast("double"))


def t_two_sided(stat: Column, df: Column) -> Column:
    return F.nanvl(_t_two_sided(stat, df.cast("double")), F.lit(None).cast("double"))
