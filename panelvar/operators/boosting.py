"""Gradient boosting on histograms, with an L2 penalty on leaves, for many training windows and settings at once.

Feature values become bins shared by all fits. Rows lie in packed blocks; for each level of each round
one job adds up gradients and hessians by (fit, node, feature, bin) in every block, then over blocks, and
returns one best split per node. So a fit never gathers its rows, and all fits advance together: the
number of jobs is rounds times depth, whatever the number of windows and settings. The driver holds the
trees alone. Scores are written into the blocks every few rounds, so a block applies few trees per job,
and a job is sent these trees only. Blocks are small enough for every core to have one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pin

BINS, BLOCK_ROWS, LEAST_ROWS, REFRESH = 64, 20_000, 1_000, 10
MIN_LEAF, PENALTY, LEAST_HESSIAN = 50, 1.0, 1e-3


@dataclass
class Tree:
    """Nodes in heap order; a node without feature is a leaf. Rows with a bin above the cut go right."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        size = 2 ** (depth + 1) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node at which each row ends; ``bins`` has a row per feature."""
        node = np.zeros(bins.shape[1], np.int64)
        every = np.arange(bins.shape[1])
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1):
            f = self.feature[node]
            right = bins[np.maximum(f, 0), every] > self.cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Fit:
    """Training rows are those whose label was known before ``cutoff``."""

    cutoff: date
    depth: int
    rate: float
    start: float = 0.0
    trees: list[Tree] = field(default_factory=list)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of all bins but the last, per feature, from approximate quantiles in one pass."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(f, at, F.lit(10_000)).alias(f) for f in features]).first()
    return [np.unique(np.asarray(found[f] or [], float)) for f in features]


def _blocks(rows: DataFrame, keys: Sequence[str], features: Sequence[str], edges: list[np.ndarray], fits: int) -> DataFrame:
    """Rows in blocks: keys as lists, known (days), y and bins packed, scores zero."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), BLOCK_ROWS):
                part = frame.iloc[at : at + BLOCK_ROWS]
                bins = np.stack([np.searchsorted(e, part[f].to_numpy(float)) for f, e in zip(features, edges)]).astype(np.uint8)
                one = {k: [part[k].tolist()] for k in keys}
                one |= {"known": [part["known"].to_numpy(np.int32).tobytes()], "y": [part["y"].to_numpy(np.int8).tobytes()]}
                yield pd.DataFrame(one | {"bins": [bins.tobytes()], "scores": [np.zeros((fits, len(part))).tobytes()]})

    known = F.coalesce(F.datediff("label_known_date", F.lit(date(1970, 1, 1))), F.lit(2**31 - 1))
    slim = rows.select(*keys, "y", known.alias("known"), *features)
    types = ", ".join(f"{k} array<{slim.schema[k].dataType.simpleString()}>" for k in keys)
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(n / BLOCK_ROWS), min(cores, n // LEAST_ROWS))
    return pin(slim.repartition(parts).mapInPandas(pack, f"{types}, known binary, y binary, bins binary, scores binary"))


def _recent(fits: list[Fit], since: int) -> list[Fit]:
    """The fits with the trees that the blocks' scores lack: all that a job needs, however long the fits are."""
    return [replace(f, trees=f.trees[since:]) for f in fits]


def _opened(block, fits: list[Fit], deeper: int = -1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(fit, bins, y, mask of training rows, score with all trees) of one block, for fits deeper than ``deeper``."""
    y = np.frombuffer(block.y, np.int8)
    known = np.frombuffer(block.known, np.int32)
    bins = np.frombuffer(block.bins, np.uint8).reshape(-1, len(y))
    scores = np.frombuffer(block.scores, float).reshape(len(fits), len(y))
    for k, fit in enumerate(fits):
        if fit.depth <= deeper:
            continue
        score = scores[k].copy()
        for tree in fit.trees:
            score += tree.value[tree.places(bins)]
        yield k, bins, y, known < (fit.cutoff - date(1970, 1, 1)).days, score


_SPLIT = "fit int, node int, feature int, cut int, g double, h double, n double, g_left double, h_left double"


def _splits(blocks: DataFrame, fits: list[Fit], growing: list[Tree], level: int, bins: int, min_leaf: int, penalty: float) -> DataFrame:
    """The best split of every node of one level (feature -1 where none gains), with the node's sums."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for block in frame.itertuples(index=False):
                for k, x, y, train, score in _opened(block, fits, level):
                    if not train.any():
                        continue
                    x = x[:, train]
                    p = 1 / (1 + np.exp(-(score[train] + fits[k].start)))
                    node = growing[k].places(x)
                    for one in np.unique(node[node >= 2**level - 1]).tolist():
                        mine = node == one
                        g, h = (p - y[train])[mine], (p * (1 - p))[mine]
                        at = (x[:, mine] + bins * np.arange(len(x))[:, None]).ravel()
                        sums = np.stack([np.bincount(at, np.tile(w, len(x)), bins * len(x)).reshape(len(x), bins) for w in (g, h, np.ones(len(g)))])
                        key = (k, one)
                        total[key] = total[key] + sums if key in total else sums
        rows = [(k, one, sums.tobytes()) for (k, one), sums in total.items()]
        yield pd.DataFrame(rows, columns=["fit", "node", "sums"])

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(frame["sums"])  # a fixed order of addition
        sums = sum(np.frombuffer(s, float) for s in parts).reshape(3, -1, bins)
        g, h, n = (float(sums[k, 0].sum()) for k in range(3))
        gl, hl, nl = np.cumsum(sums, axis=2)[:, :, :-1]
        gain = gl**2 / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g**2 / (h + penalty)
        good = (nl >= min_leaf) & (n - nl >= min_leaf) & (hl >= LEAST_HESSIAN) & (h - hl >= LEAST_HESSIAN)
        gain = np.where(good, gain, -np.inf)
        f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[f, cut] > 1e-12:
            f, cut = -1, 0
        left = (float(gl[f, cut]), float(hl[f, cut])) if f >= 0 else (0.0, 0.0)
        return pd.DataFrame([(frame["fit"].iat[0], frame["node"].iat[0], f, cut, g, h, n, *left)], columns=[c.split()[0] for c in _SPLIT.split(", ")])

    return blocks.mapInPandas(add, "fit int, node int, sums binary").groupBy("fit", "node").applyInPandas(best, _SPLIT)


def _refreshed(blocks: DataFrame, fits: list[Fit]) -> DataFrame:
    def refresh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = [np.stack([s for *_, s in _opened(block, fits)]).tobytes() for block in frame.itertuples(index=False)]
            yield frame.assign(scores=scores)

    return pin(blocks.mapInPandas(refresh, blocks.schema))


def boost(
    rows: DataFrame, features: Sequence[str], fits: list[Fit], keys: Sequence[str] = ("asset", "as_of_date"), iterations: int = 150,
    bins: int = BINS, min_leaf: int = MIN_LEAF, penalty: float = PENALTY,
) -> DataFrame:
    """Fits all of ``fits`` (their trees are filled in) and returns (fit, keys..., y, known, prob) of every row under every fit.

    ``rows`` have the keys, y (0 or 1), label_known_date and features without nulls; known is the label's day in days since 1970.
    """
    features, keys = list(features), list(keys)
    counts = rows.agg(*[F.struct(F.count_if(F.col("label_known_date") < F.lit(f.cutoff)).alias("n"), F.sum(F.when(F.col("label_known_date") < F.lit(f.cutoff), F.col("y"))).alias("s")).alias(f"f{k}") for k, f in enumerate(fits)]).first()
    for k, fit in enumerate(fits):
        n, s = counts[f"f{k}"]["n"], counts[f"f{k}"]["s"] or 0
        fit.start = math.log(s / (n - s)) if 0 < s < n else 0.0
        fit.trees = []
    blocks = _blocks(rows, keys, features, bin_edges(rows, features, bins), len(fits))
    since = 0
    for turn in range(iterations):
        growing = [Tree.empty(f.depth) for f in fits]
        for level in range(max(f.depth for f in fits)):
            for r in _splits(blocks, _recent(fits, since), growing, level, bins, min_leaf, penalty).collect():  # a row per node
                tree, rate = growing[r["fit"]], fits[r["fit"]].rate
                tree.value[r["node"]] = -rate * r["g"] / (r["h"] + penalty)
                if r["feature"] >= 0:
                    tree.feature[r["node"]], tree.cut[r["node"]] = r["feature"], r["cut"]
                    for side, (g, h) in enumerate(((r["g_left"], r["h_left"]), (r["g"] - r["g_left"], r["h"] - r["h_left"]))):
                        tree.value[2 * r["node"] + 1 + side] = -rate * g / (h + penalty)
        for fit, tree in zip(fits, growing):
            fit.trees.append(tree)
        if (turn + 1) % REFRESH == 0 or turn + 1 == iterations:
            blocks = _refreshed(blocks, _recent(fits, since))
            since = turn + 1

    bare = _recent(fits, since)

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame.itertuples(index=False):
                own = {k: list(getattr(block, k)) for k in keys}
                known = np.frombuffer(block.known, np.int32)
                for k, _, y, _, score in _opened(block, bare):
                    yield pd.DataFrame({"fit": k, **own, "y": y.astype(np.int32), "known": known, "prob": 1 / (1 + np.exp(-(score + bare[k].start)))})

    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return blocks.mapInPandas(scored, f"fit int, {types}, y int, known int, prob double")
