"""Centroid clustering of integer vectors; the nearest centroid is found by a tournament of bisectors.

A vector is nearer to centroid j than to centroid i < j exactly where 2 (c_j - c_i) . v exceeds
|c_j|^2 - |c_i|^2. These normals and thresholds are worked out once a round for all pairs; each vector
then goes through k - 1 sign tests, each of which eliminates one centroid for good, and zero favours
the smaller number. Only the distance to the winner is computed, exactly.

All arithmetic is on whole numbers, so a round's sums do not depend on where rows lie. A task adds its
vectors up before anything is shuffled, and one row per centroid reaches the driver in a round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch

SIZE, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Whole numbers up to this size keep every product and sum below 2^63; beyond, Python's numbers are used.
SMALL = 1 << 25
LONGEST = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers: int64, or Python's whole numbers where one is too large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * SCALE)
    if not x.size or np.abs(scaled).max() <= SMALL:
        return scaled.astype(np.int64)
    exact = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


class Tournament:
    """Normals and thresholds of all pairs of centroids (k at most some dozens)."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, object)
        self.small = all(abs(x) <= SMALL for row in centroids for x in row)
        square = (c * c).sum(axis=1)
        self.c = self._fit(c)
        self.normals = self._fit(2 * (c[None, :] - c[:, None]))
        self.thresholds = self._fit(square[None, :] - square[:, None])

    def _fit(self, a: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) if self.small else a

    def winners(self, v: np.ndarray) -> np.ndarray:
        best = np.zeros(len(v), np.int64)
        for j in range(1, len(self.c)):
            side = (v * self.normals[best, j]).sum(axis=1) - self.thresholds[best, j]
            best[np.asarray(side > 0, bool)] = j
        return best

    def distances(self, v: np.ndarray, best: np.ndarray) -> np.ndarray:
        return ((v - self.c[best]) ** 2).sum(axis=1)


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = SIZE) -> DataFrame:
    """vec_id, x: the rows whose vector has ``size`` components, none null or non-finite."""
    x = F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double"))
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x"))
    return rows.where((F.size("x") == size) & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < math.inf)))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return whole(np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, size))


def seeds(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; equal ids go by their components, null ids last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "x").limit(k).collect()
    return [[int(v) for v in whole(np.array(r["x"], float)).tolist()] for r in first]


def _sums(rows: DataFrame, centroids: list[list[int]], size: int) -> DataFrame:
    """cluster, n and the componentwise sums s0.. of each non-empty cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Tournament(centroids)
        n, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), size), object)
        for batch in batches:
            v = _matrix(batch.column("x"), size)
            best = match.winners(v)
            n += np.bincount(best, minlength=len(n))
            for j in np.unique(best):
                total[j] += v[best == j].sum(axis=0)
        some = np.flatnonzero(n)
        columns = [pa.array(some, pa.int32()), pa.array(n[some], pa.int64())]
        columns += [pa.array([int(t) for t in total[some, d]], pa.decimal128(38, 0)) for d in range(size)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *names])

    names = [f"s{d}" for d in range(size)]
    parts = rows.select("x").mapInArrow(add, "cluster int, n bigint, " + ", ".join(f"{s} decimal(38,0)" for s in names))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])


def fit(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> list[list[int]]:
    """The centroids after ``rounds`` rounds over ``kept`` rows; fewer than k rows give fewer centroids.

    A round replaces every non-empty centroid by floor(sum / count) of its vectors; empty ones stay.
    """
    centroids = seeds(rows, k, seed)
    for _ in range(rounds if centroids else 0):
        for r in _sums(rows, centroids, size).collect():  # a row per centroid
            centroids[r["cluster"]] = [int(r[f"s{d}"]) // r["n"] for d in range(size)]
    return centroids


def assign(rows: DataFrame, centroids: list[list[int]], size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance (squared) of every kept row; a distance beyond 64 bits is null."""
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Tournament(centroids) if centroids else None  # no centroid, no row
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("x"), size)
            best = match.winners(v)
            far = [int(d) if d <= LONGEST else None for d in match.distances(v, best).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(nearest, f"vec_id {id_type}, cluster int, distance bigint")


def cluster(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components joined by commas).

    Vectors that are null, of another length, or hold null or non-finite components take no part and
    have no row; the zero vector does. Null and repeated ids count row by row. Ties go to the smaller
    number. An empty table gives an empty one. Distances and inertia beyond 64 bits are null.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    rows = kept(vectors, vec_id, embedding, size)
    centroids = fit(rows, k, rounds, seed, size)
    found = scratch.save(assign(rows, centroids, size), free=False)
    sums = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    total = sum(int(r["s"] or 0) for r in sums.values())
    lost = any(r["lost"] for r in sums.values())

    def fits(x: int, broken: bool) -> int | None:
        return None if broken or x > LONGEST else x

    table = [(j, fits(int(r["s"] or 0), r["lost"] > 0), fits(total, lost), ",".join(map(str, centroids[j]))) for j, r in sums.items()]
    report = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid string")
    return found.join(F.broadcast(report), "cluster")  # a row per centroid


def query(spark, sf_dir: str) -> DataFrame:
    found = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _round(k: int) -> str:
    return f"""
a{k} AS MATERIALIZED (
  SELECT r, CAST(low % 16 AS INTEGER) AS c, CAST(low // 16 AS BIGINT) AS d FROM (
    SELECT r, min(16 * list_sum(list_transform(range(1, 65), lambda i: CAST((v[i] - w[i]) * (v[i] - w[i]) AS HUGEINT))) + c) AS low
    FROM vectors, c{k} GROUP BY r)),
m{k} AS MATERIALIZED (
  SELECT c, list(floored ORDER BY i) AS w FROM (
    SELECT c, i, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS floored
    FROM (SELECT a.c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM vectors JOIN a{k} a USING (r)) GROUP BY c, i) GROUP BY c),
c{k + 1} AS MATERIALIZED (SELECT c, coalesce(m.w, o.w) AS w FROM c{k} o LEFT JOIN m{k} m USING (c)),"""


ORACLE = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w
  FROM (SELECT sha256('1:' || vec_id) AS h, v FROM vectors ORDER BY h, v LIMIT 16)),
{_round(0)}{_round(1)}{_round(2)}
a3 AS MATERIALIZED (
  SELECT r, CAST(low % 16 AS INTEGER) AS c, CAST(low // 16 AS BIGINT) AS d FROM (
    SELECT r, min(16 * list_sum(list_transform(range(1, 65), lambda i: CAST((v[i] - w[i]) * (v[i] - w[i]) AS HUGEINT))) + c) AS low
    FROM vectors, c3 GROUP BY r))
SELECT vec_id, c AS cluster, d AS distance,
  CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(w, ',')) AS centroid_sha256
FROM vectors JOIN a3 USING (r) JOIN c3 USING (c)
"""
