"""Asymmetric GARCH(1,1) with Gaussian quasi-likelihood: h = omega + (alpha + gamma*[r<0]) r^2 + beta*h.

Returns are in percent. One row per (series, fit window) carries its returns as an array, bounded by
the calendar, and rows are spread over the cluster. Variance paths are window recursions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import ratio
from ..functions.recursion import linear_recursion

# Parameter bounds and starting points (alpha, gamma, beta).
MAX_ALPHA, MAX_GAMMA, MAX_BETA, MAX_PERSISTENCE, MIN_OMEGA = 0.5, 0.8, 0.9999, 0.9995, 1e-6
STARTS = ((0.05, 0.05, 0.88), (0.03, 0.10, 0.90), (0.08, 0.02, 0.85))
#: A start ends when its next step promises less gain in likelihood than this; one that has not ended after
#: so many steps is marked as not converged.
LEAST_GAIN, MOST_ROUNDS = 1e-8, 200
#: Rows of a block of the variance recursion.
BLOCK = 64

PARAMS = ("omega", "alpha", "gamma", "beta")


@dataclass(frozen=True)
class GJR:
    omega: float
    alpha: float
    gamma: float
    beta: float

    def columns(self) -> dict[str, Column]:
        return {p: F.lit(float(getattr(self, p))) for p in PARAMS}


def neg_loglik(r: np.ndarray, h0: float, omega, alpha, gamma, beta) -> np.ndarray:
    """Half the sum of ln h + r^2/h along the variance recursion, for arrays of parameter sets."""
    h = np.full(np.shape(omega), h0)
    total = np.zeros_like(h)
    square = r * r
    up, down = alpha, alpha + gamma
    for t in range(len(r)):
        total += np.log(h) + square[t] / h
        h = omega + (down if r[t] < 0 else up) * square[t] + beta * h
    return total / 2


#: The feasible set A x <= b of (omega, alpha, gamma, beta): bounds and persistence.
_A = np.array([[-1, 0, 0, 0], [0, -1, 0, 0], [0, 1, 0, 0], [0, 0, -1, 0], [0, 0, 1, 0], [0, 0, 0, -1], [0, 0, 0, 1], [0, 1, 0.5, 1]], float)
_B = np.array([-MIN_OMEGA, 0, MAX_ALPHA, 0, MAX_GAMMA, 0, MAX_BETA, MAX_PERSISTENCE])


def recursion(inputs: np.ndarray, rho: float) -> np.ndarray:
    """s_t = rho * s_(t-1) + inputs_t along the last axis: blocks by one matrix product, their ends by the same again."""
    n = inputs.shape[-1]
    blocks = -(-n // BLOCK)
    padded = np.zeros((*inputs.shape[:-1], blocks * BLOCK))
    padded[..., :n] = inputs
    age = np.arange(BLOCK)
    power = rho ** np.arange(BLOCK + 1.0)
    power[power < 1e-200] = 0.0  # denormal numbers are slow
    weight = np.tril(power[np.abs(age[:, None] - age)])
    local = padded.reshape(*inputs.shape[:-1], blocks, BLOCK) @ weight.T
    if blocks > 1:
        ends = recursion(local[..., -1], power[BLOCK])
        local[..., 1:, :] += ends[..., :-1, None] * power[1:]
    return local.reshape(*inputs.shape[:-1], blocks * BLOCK)[..., :n]


class Likelihood:
    """Half the sum of ln h + r^2/h of one series, with its score and expected information."""

    def __init__(self, r: np.ndarray):
        self.square = r * r
        self.h0 = float(np.var(r))
        # What a day's variance gets from the day before, by parameter; the last, its variance, is filled in later.
        self.inputs = np.zeros((4, len(r)))
        self.inputs[0, 1:], self.inputs[1, 1:] = 1.0, self.square[:-1]
        self.inputs[2, 1:] = np.where(r[:-1] < 0, self.square[:-1], 0.0)

    def variance(self, x: np.ndarray) -> np.ndarray:
        drive = x[:3] @ self.inputs[:3]
        drive[0] = self.h0
        return recursion(drive, float(x[3]))

    def value(self, x: np.ndarray) -> float:
        h = self.variance(x)
        return float((np.log(h) + self.square / h).sum() / 2)

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.variance(x)
        inputs = self.inputs.copy()
        inputs[3, 1:] = h[:-1]
        slope = recursion(inputs, float(x[3])) / h
        return slope @ (1 - self.square / h) / 2, slope @ slope.T / 2


def bounded_step(gradient: np.ndarray, curvature: np.ndarray, room: np.ndarray, unit: np.ndarray | float = 1.0) -> np.ndarray:
    """The step d (in ``unit``) that minimises g.d + d.H.d / 2 within A (unit d) <= room, by a primal active set from d = 0."""
    bounds = _A * unit
    bounds_size = np.linalg.norm(bounds, axis=1)
    bounds, room = bounds / bounds_size[:, None], room / bounds_size
    n, d = len(gradient), np.zeros(len(gradient))
    active: list[int] = []
    for _ in range(100):
        k = len(active)
        system = np.zeros((n + k, n + k))
        system[:n, :n] = curvature
        system[n:, :n], system[:n, n:] = bounds[active], bounds[active].T
        right = np.concatenate([-(gradient + curvature @ d), np.zeros(k)])
        solved = np.linalg.lstsq(system, right, rcond=1e-14)[0]
        move, weight = solved[:n], solved[n:]
        if np.abs(move).max() <= 1e-12 * (1 + np.abs(d).max()):
            if not k or weight.min() >= -1e-9:
                return d
            active.pop(int(weight.argmin()))
            continue
        pace, left = bounds @ move, room - bounds @ d
        pace[active] = 0.0
        blocking = np.flatnonzero(pace > 1e-14)
        share = np.maximum(left[blocking], 0) / pace[blocking]
        if len(blocking) and share.min() < 1:
            d = d + share.min() * move
            active.append(int(blocking[share.argmin()]))
        else:
            d = d + move
    return d


def _free_directions(gradient: np.ndarray, bounds: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Columns that span the directions along the bounds against which the likelihood pushes."""
    at = bounds[room <= 1e-9]
    if len(at):
        at = at[np.linalg.lstsq(at.T, -gradient, rcond=None)[0] > 0]
    if not len(at):
        return np.eye(len(gradient))
    _, size, axes = np.linalg.svd(at)
    return axes[(size > 1e-12 * size.max()).sum() :].T


def _ascend(target: Likelihood, x: np.ndarray, most_rounds: int) -> tuple[np.ndarray, float, bool]:
    """Newton steps in bounds until none promises a gain.

    The curvature comes from differences of the score, in units of the parameters' standard errors;
    where it isn't positive in every direction that the bounds leave free, the expected information,
    which always is, stands in.
    """
    low = target.value(x)
    for _ in range(most_rounds):
        gradient, information = target.score(x)
        unit = 1 / np.sqrt(np.maximum(np.diag(information), 1e-300))
        rows = [(target.score(x + d)[0] - gradient) / 1e-5 for d in np.diag(unit * 1e-5)]
        scaled = information * np.outer(unit, unit) + 1e-9 * np.eye(len(x))
        free = _free_directions(gradient * unit, _A * unit, _B - _A @ x)
        inside = free.T @ (np.stack(rows) * unit) @ free
        if len(inside) and np.linalg.eigvalsh(inside + inside.T).min() > 1e-6:
            held = np.eye(len(x)) - free @ free.T
            scaled = held @ scaled @ held + free @ (inside + inside.T) @ free.T / 2
        scaled = (scaled + scaled.T) / 2
        curvature = scaled / np.outer(unit, unit)
        step = bounded_step(gradient * unit, scaled, _B - _A @ x, unit) * unit
        gain = -(gradient @ step + step @ curvature @ step / 2)
        if gain <= LEAST_GAIN:
            return x, low, True
        share = 1.0
        while True:
            there = np.clip(x + share * step, [MIN_OMEGA, 0, 0, 0], [math.inf, MAX_ALPHA, MAX_GAMMA, MAX_BETA])
            value = target.value(there)
            if value <= low - 1e-4 * share * gain:
                break
            share /= 2
            if share < 1e-9:  # no decrease along the step: rounding, where the promised gain is below it
                return x, low, gain <= 1e-10 * abs(low)
        x, low = there, value
    return x, low, False


def search(r: np.ndarray, most_rounds: int = MOST_ROUNDS) -> tuple[float, float, float, float, float, float, bool]:
    """(h0, omega, alpha, gamma, beta, nll, converged): Newton steps in bounds from every start, the best end counts.

    The score follows the variance recursion analytically; a step solves a quadratic programme within
    all bounds, so an optimum on a bound is reached exactly. A start counts
    as converged where no step within the bounds promises a gain. A series without variance has no fit.
    """
    target = Likelihood(r)
    if not target.h0 > 0:
        return (target.h0, *[math.nan] * 5, False)
    ends = []
    for a, g, b in STARTS:
        x = np.array([max(target.h0 * (1 - a - g / 2 - b), MIN_OMEGA), a, g, b])
        ends.append(_ascend(target, x, most_rounds))
    x, low, converged = min(ends, key=lambda e: (e[1] if e[2] else math.inf, e[1]))
    return (target.h0, *map(float, x), low, converged)


def maximise(r: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """(h0, omega, alpha, gamma, beta, nll) of a search that has converged."""
    *found, converged = search(r)
    if not converged:
        raise RuntimeError("GARCH fit failed to converge")
    return tuple(found)


_FIT_TYPE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("h0", *PARAMS, "nll")] + [T.StructField("converged", T.BooleanType())])


@F.pandas_udf(_FIT_TYPE)
def _fit(rets: pd.Series) -> pd.DataFrame:
    fits = [search(np.asarray(r, float)) for r in rets]
    return pd.DataFrame(fits, columns=["h0", *PARAMS, "nll", "converged"])


def fit_gjr(series: DataFrame) -> DataFrame:
    """Adds h0, omega, alpha, gamma, beta, nll, converged to rows with ``rets`` (percent returns, in date order).

    One row is one fit; Spark spreads the rows, and a fit touches only its own array.
    """
    return series.withColumn("_f", _fit("rets")).select("*", "_f.*").drop("_f")


def settled(fits: DataFrame) -> DataFrame:
    """The fits without their flag; one that has not converged fails the query."""
    failed = F.raise_error(F.lit("GARCH fit failed to converge")).cast("double")
    return fits.withColumn("h0", F.when(F.col("converged"), F.col("h0")).otherwise(failed)).drop("converged")


def return_arrays(returns: DataFrame, by: Sequence[str] = ("asset",), ret: str = "r") -> DataFrame:
    """(by..., rets): percent returns of each series in date order."""
    pairs = F.sort_array(F.collect_list(F.struct("trade_date", (F.col(ret) * 100).alias("x"))))
    return (
        returns.where(F.col(ret).isNotNull())
        .groupBy(*by)
        .agg(pairs.alias("_p"))
        .select(*by, F.transform("_p", lambda p: p["x"]).alias("rets"))
    )


def _shock(x: Column) -> Column:
    return (F.col("alpha") + F.when(x < 0, F.col("gamma")).otherwise(0.0)) * x * x


def variance_path(rows: DataFrame, by: Sequence[str] = ("asset",), x: str = "x") -> DataFrame:
    """Adds ``h``: variance of each row's return given the rows before it; the first is ``h0``.

    ``rows`` carry x (percent), h0 and the four parameters.
    """
    series = Window.partitionBy(*by).orderBy("trade_date")
    drive = F.lag(F.col("omega") + _shock(F.col(x))).over(series)
    prepared = rows.withColumn("_e", F.coalesce(drive, F.col("h0")))
    return linear_recursion(prepared, by, "trade_date", F.col("beta"), "_e", "h").drop("_e")


def next_variance(x: str = "x") -> Column:
    return F.col("omega") + _shock(F.col(x)) + F.col("beta") * F.col("h")


def average_forecast(horizon: int, x: str = "x") -> Column:
    """Mean of the 1..horizon step variance forecasts made at each row, in closed form."""
    p = F.col("alpha") + F.col("gamma") / 2 + F.col("beta")
    level = ratio(F.col("omega"), 1 - p)
    weight = ratio(1 - F.pow(p, F.lit(horizon)), horizon * (1 - p))
    return level + (next_variance(x) - level) * weight
