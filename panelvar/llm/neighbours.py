"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected at random to a few coordinates, shifted, and numbered along a Hilbert curve;
each of several curves has its own projection and shift. Spark range-sorts all vectors by curve and
number. A query's candidates are the rows within a window of places to both sides of it on any
curve; the sorted rows are cut into blocks of fixed size, a query goes to every block that its
windows reach, blocks keep its nearest rows by exact distance, and the blocks' answers merge.

How wide a window must be depends on the data, so it is fitted: for a bounded sample of the queries
the true neighbours are found among all rows, and the window is the least that reaches the wanted
share of them. All rows are indexed and searched alike at every size.

Equal vectors are one row with their smallest ids, one more than are asked for: with ties going to
the smaller id no other id can be among a query's nearest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch, parallelism

NEAREST, CURVES, COORDINATES, BITS = 10, 24, 12, 5
#: Share of true neighbours that the window must reach on the sample, and the sample's size.
RECALL, SAMPLE = 0.95, 96
#: Rows of a block.
BLOCK_ROWS = 4096
SEED = 7


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along a Hilbert curve of points (a row each) with coordinates of ``bits`` bits.

    After J. Skilling, Programming the Hilbert curve (2004): undo the excess work from the highest
    bit down, then Gray-decode; the bits of the result interleave to the number.
    """
    x, n = x.astype(np.uint32).T.copy(), x.shape[1]
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= np.uint32(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    q = np.uint32(1 << (bits - 1))
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= np.uint32(1)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> np.uint32(b)) & 1).astype(np.int64)
    return key


def curve_numbers(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Numbers of vectors on one curve, after scaling to unit length so that one grid fits all."""
    rng = np.random.default_rng((SEED, curve, vectors.shape[1]))
    project = rng.standard_normal((vectors.shape[1], COORDINATES))
    shift = rng.random(COORDINATES)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    # Coordinates of unit vectors are about normal; arctan spreads them over the grid.
    grid = np.arctan(1.5 * (unit @ project)) / np.pi + 0.5
    cells = np.clip((grid + shift) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells, BITS)


def usable(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id, v (binary doubles' source as array<double>) of the rows that take part.

    Left out: null ids or vectors, vectors with null or non-finite components, zero vectors, and
    those whose dimension isn't the most frequent one (the larger of two as frequent).
    """
    v = F.col(embedding).cast("array<double>")
    rows = rows.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    return rows


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def _keyed(distinct: DataFrame) -> DataFrame:
    """row, curve, number: every vector on every curve."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<f8").reshape(batch.num_rows, -1)
            for curve in range(CURVES):
                key = curve_numbers(v, curve)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(np.full(len(key), curve), pa.int32()), pa.array(key, pa.int64())], ["row", "curve", "number"]
                )

    return distinct.select("row", "v").mapInArrow(number, "row bigint, curve int, number bigint")


def _places(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """row, curve, place: places from 0 along each curve, by a distributed range sort."""
    spark = scratch.spark

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            columns = [batch.column("row"), batch.column("curve"), pa.array(np.full(len(n), block), pa.int32()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "curve", "block", "at"])

    order = ("curve", "number", "row")
    ordered = keyed.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    table = scratch.save(ordered.mapInArrow(count, "row bigint, curve int, block int, at bigint"), free=False)
    # One row per partition and curve says where the curve stands there and how much lies before.
    blocks = table.groupBy("curve", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("block")) - F.col("n")
    blocks = blocks.select(F.col("curve").alias("c"), F.col("block").alias("k"), (before - F.col("first")).alias("shift"))
    joined = table.join(blocks, (F.col("curve") == F.col("c")) & (F.col("block") == F.col("k")))
    return scratch.save(joined.select("row", "curve", (F.col("at") + F.col("shift")).alias("place")), free=False)


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows[None, :, :] - queries[:, None, :]).sum(axis=2))


def _true_neighbours(distinct: DataFrame, sample: DataFrame, nearest: int) -> DataFrame:
    """query, row: exact neighbours of the sample's rows among all rows, in blocks of rows."""
    taken = sample.select("row", "v").collect()  # at most SAMPLE rows
    ids = np.array([r["row"] for r in taken], np.int64)
    table = np.stack([np.frombuffer(r["v"], "<f8") for r in taken])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                rows = part["row"].to_numpy()
                v = _matrix(part["v"])
                for k, q in enumerate(ids):
                    d = np.where(rows == q, np.inf, _distances(table[k : k + 1], v)[0])
                    best = np.argsort(d, kind="stable")[:nearest]
                    best = best[np.isfinite(d[best])]
                    yield pd.DataFrame({"query": q, "row": rows[best], "d": d[best]})

    found = distinct.select("row", "v").mapInPandas(near, "query bigint, row bigint, d double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query", "row")


def fitted_window(distinct: DataFrame, asked: DataFrame, places: DataFrame, nearest: int, scratch: Scratch) -> int:
    """The least window that reaches RECALL of the sample's true neighbours on some curve."""
    sample = asked.orderBy(F.xxhash64("row")).limit(SAMPLE)
    sample = scratch.save(sample, free=False)
    if sample.isEmpty():
        return 1
    true = scratch.save(_true_neighbours(distinct, sample, nearest), free=False)
    mine = places.join(F.broadcast(sample.select("row")), "row").select(F.col("row").alias("query"), "curve", F.col("place").alias("here"))
    there = places.join(F.broadcast(true.select("row").distinct()), "row")
    gaps = true.join(there, "row").join(F.broadcast(mine), ["query", "curve"]).groupBy("query", "row").agg(F.min(F.abs(F.col("place") - F.col("here"))).alias("gap"))
    wide = sorted(r["gap"] for r in gaps.collect())  # at most SAMPLE x nearest numbers
    return max(1, int(wide[min(len(wide) - 1, int(np.ceil(RECALL * len(wide))))])) if wide else 1


def search(rows: DataFrame, queries, vec_id: str = "vec_id", embedding: str = "embedding", nearest: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in double precision).

    ``queries`` is a condition on the id (a function of a column). Rows named by ``usable`` take no
    part; ties go to the smaller id; a row is not its own neighbour, but an equal vector under
    another id is; rows that repeat id and vector count once; with few rows all are returned; an
    empty table gives an empty one.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    alive = usable(rows, vec_id, embedding)
    lengths = alive.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dimension = lengths["d"] if lengths else 0
    alive = alive.where(F.size("v") == dimension)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + 0.0  # -0.0 is 0.0
            data = [x.astype("<f8").tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "v"])

    alive = scratch.save(alive.mapInArrow(packed, "id bigint, v binary").withColumn("h", F.xxhash64("v")), free=False)
    first = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    few = alive.distinct().withColumn("r", first).where(F.col("r") <= nearest + 1)
    distinct = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = scratch.save(distinct.select("v", "ids", F.monotonically_increasing_id().alias("row")))
    asked_ids = alive.where(queries(F.col("id"))).select("id", "h", "v").distinct()
    asked = asked_ids.select("h", "v").distinct().join(distinct.select(F.xxhash64("v").alias("h"), F.col("v").alias("w"), "row"), "h").where("v = w").select("row", "v")
    asked = scratch.save(asked, free=False)
    places = _places(_keyed(distinct), scratch)
    window = fitted_window(distinct, asked, places, nearest, scratch)

    block = F.floor(F.col("place") / BLOCK_ROWS).cast("int")
    blocks = places.join(distinct, "row").select("curve", block.alias("block"), "place", "row", "v", "ids")
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("place") - window) / BLOCK_ROWS)).cast("int"), F.floor((F.col("place") + window) / BLOCK_ROWS).cast("int"))
    askers = places.join(asked, "row").select(
        F.col("curve").alias("on"), F.explode(reach).alias("part"), F.col("place").alias("at"), F.col("row").alias("query"), F.col("v").alias("mine")
    )

    def nearby(key, here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(here) and len(there):
            v, place = _matrix(there["v"]), there["place"].to_numpy()
            ids = there["ids"].tolist()
            for query, at, mine in zip(here["query"], here["at"], _matrix(here["mine"])):
                inside = np.flatnonzero(np.abs(place - at) <= window)
                if not len(inside):
                    continue
                d = np.sqrt(np.square(v[inside] - mine).sum(axis=1))
                limit = np.partition(d, min(nearest, len(d) - 1))[min(nearest, len(d) - 1)]
                for k in np.flatnonzero(d <= limit):  # ties stay; each stands for up to nearest + 1 ids
                    out.append((query, ids[inside[k]], float(d[k])))
        return pd.DataFrame(out, columns=["query", "ids", "score"])

    found = askers.groupBy("on", "part").cogroup(blocks.groupBy("curve", "block")).applyInPandas(nearby, "query bigint, ids array<bigint>, score double")
    found = found.distinct().select("query", F.explode("ids").alias("vec_id"), "score").distinct()
    # All ids that ask with a vector share its answers; each leaves itself out.
    best = F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))
    found = found.withColumn("r", best).where(F.col("r") <= nearest + 1).drop("r")
    rows_of = asked.select(F.xxhash64("v").alias("h"), F.col("v").alias("w"), F.col("row").alias("query"))
    askers = asked_ids.join(rows_of, "h").where("v = w").select(F.col("id").alias("query_id"), "query")
    answers = askers.join(found, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return answers.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= nearest)


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 100 == 0)
