"""Periodic runs of words: maximal stretches in which a passage repeats at least three times in a row.

A word that equals the word q places before it lengthens the match on the diagonal of lag q; a match
of m words on that diagonal is a stretch of m + q words with period q. The diagonals are followed
online and sparsely. For lags up to a power of two, L, a word looks at the earlier occurrences of the
L words that end with it, of which only the latest matters: where a stretch of smallest period
q <= L has room for these words and one period more, the latest earlier occurrence lies exactly q
places back (a nearer one would make a rotation of a primitive passage equal to itself). So each level
L has one active lag per word. While the lag stays, the match grows by one; where it changes or ends,
the diagonal is closed, and emitted at once if it is long enough. A level costs one ranking of pairs of
the level before, so a text of n words takes n log n steps however often its words recur.

Level 16 serves lags up to 16 (a run of at least 24 words has room for it), each further level the
lags between its half and itself, up to a third of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelvar.llm.shared import words

LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The first level, and the largest lag whose shortest run has room for it.
FIRST = 16


def _ranks(pairs: np.ndarray) -> np.ndarray:
    return np.unique(pairs, return_inverse=True)[1].astype(np.int64).ravel()


def _doubled(ids: np.ndarray, width: int) -> np.ndarray:
    """Ranks of the stretches of 2 * width words from those of width words."""
    a, b = ids[:-width], ids[width:]
    return _ranks(a * (int(ids.max()) + 1) + b)


def _latest(ids: np.ndarray) -> np.ndarray:
    """How many places back the latest earlier occurrence of each stretch starts; 0 where there is none."""
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    lag = np.zeros(len(ids), np.int64)
    lag[order[1:][same]] = (order[1:] - order[:-1])[same]
    return lag


def _closed(lag: np.ndarray, width: int, low: int, high: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the diagonals of one level with low < lag <= high that end long enough."""
    edges = np.flatnonzero(np.diff(lag)) + 1
    begins = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(lag)]])
    q = lag[begins]
    length = ends - begins + width - 1 + q
    good = (q > low) & (q <= high) & (length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q))
    for b, n, p in zip(begins[good].tolist(), length[good].tolist(), q[good].tolist()):
        yield b - p, n, p


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers (0 up), by start, then period."""
    n, width, found = len(ids), 1, []
    if n < LEAST_WORDS:
        return found
    level = ids.astype(np.int64)
    while width < FIRST:
        level, width = _doubled(level, width), 2 * width
    low = 0
    while True:
        lag = _latest(level)
        if not lag.any():  # nothing of this width recurs, so nothing longer does
            break
        found.extend(_closed(lag, width, low, width))
        # A run of a larger period is at least three of them long.
        if LEAST_PERIODS * (width + 1) > n or len(level) <= width:
            break
        low = width
        level, width = _doubled(level, width), 2 * width
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties go to the smallest start, then period."""
    best = None
    for start, length, period in found:  # by start, then period
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapse(text: bytes) -> tuple[list[tuple[int, int, int]], list[bytes]]:
    """The runs of a text, and its words without those that any run holds after its first period."""
    found = text.split()  # bytes: space and the five controls from tab on
    if len(found) < LEAST_WORDS:
        return [], found
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
    all_runs = runs(ids)
    if not all_runs:
        return all_runs, found
    step = np.zeros(len(found) + 1, np.int64)
    for start, length, period in all_runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step)[:-1] == 0)
    return all_runs, [found[k] for k in kept]


_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (start, length, period, by start), best (the strongest run or null), collapsed (text).

    Null and empty texts have no runs and an empty collapsed text. Repeated rows and null ids are rows
    like any other; an empty table gives an empty one. Columns other than the two are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found, best, short = [], [], []
                for body in part.column("text").to_pylist():
                    all_runs, left = collapse(body)
                    top = strongest(all_runs)
                    found.append([dict(zip(("start", "length", "period"), r)) for r in all_runs])
                    best.append(dict(zip(("start", "length", "period"), top)) if top else None)
                    short.append(b" ".join(left))
                columns = [part.column("doc_id"), pa.array(found, pa.list_(run)), pa.array(best, run), pa.array(short, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "best", "collapsed"])

    out = rows.mapInArrow(find, f"doc_id {id_type}, runs {_RUN}, best {_RUN[6:-1]}, collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def altered(docs: DataFrame) -> DataFrame:
    """doc_id, text: the documents with those whose number's checksum ends in 0 made periodic, as declared for the query."""
    w, h = F.col("w"), F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).cast("bigint").alias("g"))
    rows = rows.withColumn("w", F.when(F.col("chosen"), words(F.col("text")))).withColumn("n", F.size("w").cast("bigint"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    tail = F.transform(F.slice(w, F.col("a") + 1, F.col("n").cast("int") - F.col("a")), lambda x, i: w[F.col("a") + i % F.col("p")])
    text = F.array_join(F.concat(F.slice(w, F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """Null ids have no checksum: such texts stay as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = periodic_runs(altered(docs))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
