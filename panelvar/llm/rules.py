"""Quality rules: fixed base rules, then robust multivariate outliers per language and source.

Each text gives a vector of transformed statistics. For every group (language and source; language;
all) the minimum covariance determinant is sought by concentration steps: from a start at
coordinatewise medians, take the share of rows nearest by Mahalanobis distance, estimate mean and
covariance from them, repeat. A text is rejected if its distance to its group's estimate exceeds a
limit; groups with few rows use the estimate of their language, small languages that of all.

Vectors are whole numbers (1/1024 of a unit), so all sums are exact and runs agree wherever rows
lie. One step is one aggregation by group and distance bin, combined before the shuffle: it holds
counts, sums and products, and the nearest rows are the bins up to the needed count. So no group is
sorted or gathered. Covariances get a floor, since clean texts agree exactly in most statistics.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelvar.llm.shared import Scratch, without_space, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: The vector.
NAMES = ("length", "symbols", "lines", "repeats")
UNIT = 1024
#: Share of rows that an estimate rests on, rows that a group needs, steps, bins of distance.
CORE_PERCENT, LEAST_ROWS, STEPS, BINS = 75, 200, 5, 256
#: Groups up to which their estimates are sent to every task; beyond, both sides are dealt by group and one of so many shares.
BROADCAST_GROUPS, SHARES = 100_000, 64


def _chi2(x: float, k: int) -> float:
    """Share of a chi-square distribution below ``x`` (even k)."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(k // 2))


def _quantile(share: float, k: int) -> float:
    low, high = 0.0, 100.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < share else (low, mid)
    return low


#: Share of normal rows that may lie further out, and the Mahalanobis distance that gives: beyond it a text is rejected.
TAIL = 1e-9
LIMIT = math.sqrt(_quantile(1 - TAIL, len(NAMES)))
#: Standard deviations added to each estimate. Where a core has no spread in repeats, these alone decide: so a text goes
#: by itself from this share of repeated lines and of repeated words (the base rules end at 30 %) on.
LINES_ALONE, REPEATS_ALONE = 0.5, 0.25
FLOORS = (0.04, 0.06, math.sqrt(LINES_ALONE) / LIMIT, math.sqrt(REPEATS_ALONE) / LIMIT)


def _consistency(core: float, d: int = len(NAMES)) -> float:
    """What the covariance of the nearest ``core`` of normal rows must be multiplied by (even d)."""
    return core / _chi2(_quantile(core, d), d + 2)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (all columns), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = without_space(body)
    rows = docs.select(
        F.struct("*").alias("doc"),
        F.transform(words(body), lambda w: F.xxhash64(w)).alias("w"),
        F.length(plain).cast("bigint").alias("word_chars"),
        (F.length(plain) - F.length(F.translate(plain, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split(body, "\n"), lambda x: F.length(without_space(x)) > 0).alias("lines"),
    )
    n = F.size("w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))))
    rows = rows.select(
        "doc", "word_chars", "n_symbols",
        n.cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    # Only a text in which some window repeats sorts its windows, to see which.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("ordered", F.when(repeats, ordered)).drop("windows")
    pairs = F.zip_with(F.slice("ordered", F.lit(1), F.size("ordered") - 1), F.slice("ordered", F.lit(2), F.size("ordered") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))
    rows = rows.withColumn("starts", F.when(F.col("ordered").isNotNull(), starts)).drop("ordered")
    state = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered"))
    covered = F.aggregate("starts", state, lambda s, i: F.struct(i.alias("last"), (s["covered"] + F.least(F.lit(WINDOW), i - s["last"])).alias("covered")))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered["covered"], F.lit(0)).cast("bigint")).drop("starts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vector() -> list[Column]:
    """Log mean word length; square roots of shares: symbols by word, repeated lines, repeated words."""
    n = F.greatest("n_words", F.lit(1))
    shares = [F.col("n_symbols") / n, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n]
    unit = [F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0)))] + [F.sqrt(x) for x in shares]
    return [F.round(x * UNIT).cast("bigint").alias(f"x{k}") for k, x in enumerate(unit)]


def _cholesky(df: DataFrame) -> DataFrame:
    """From m_i and c_ij adds l_ij, the lower factor of the covariance with floors."""
    d = len(NAMES)
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit((FLOORS[i] * UNIT) ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            df = df.withColumn(f"l{i}{j}", value)
    return df.select("key", "rows", *[f"m{i}" for i in range(d)], *[f"l{i}{j}" for i in range(d) for j in range(i + 1)])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution, as one expression per coordinate."""
    total, y = F.lit(0.0), []
    for i in range(len(NAMES)):
        value = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            value = value - F.col(f"l{i}{j}") * y[j]
        y.append(value / F.col(f"l{i}{i}"))
        total = total + y[i] * y[i]
    return total


def _with_estimates(rows: DataFrame, found: DataFrame, key: Column, how: str = "inner") -> DataFrame:
    """``rows`` next to the row of ``found`` (one per ``key``) for their group, without gathering a group's rows."""
    found = found.withColumnRenamed("key", "_group")
    if found.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(found), key == F.col("_group"), how).drop("_group")
    found = found.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    rows = rows.withColumn("_own", (F.monotonically_increasing_id() % SHARES).cast("int"))
    return rows.join(found, (key == F.col("_group")) & (F.col("_own") == F.col("_share")), how).drop("_group", "_share", "_own")


def estimate(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """key, rows, m_i, l_ij for every group; ``rows`` has key and the vector."""
    d = len(NAMES)
    start = rows.groupBy("key").agg(
        F.count("*").alias("rows"),
        *[F.percentile(f"x{i}", F.lit(0.5)).alias(f"m{i}") for i in range(d)],
        *[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.75))).alias(f"q{i}") for i in range(d)],
    )
    for i in range(d):
        for j in range(i + 1):
            spread = (F.col(f"q{i}")[1] - F.col(f"q{i}")[0]) / 1.349
            start = start.withColumn(f"c{i}{j}", F.pow(spread, 2) + (FLOORS[i] * UNIT) ** 2 if i == j else F.lit(0.0))
    found = scratch.save(_cholesky(start))
    factor = _consistency(CORE_PERCENT / 100)
    for _ in range(STEPS):
        # Bins of equal ratio: about 3 % of distance each.
        bin_ = F.least(F.lit(BINS - 1), F.floor(F.log1p(_distance()) * 16)).cast("int")
        sums = (
            _with_estimates(rows, found.drop("rows"), F.col("key"))
            .groupBy("key", bin_.alias("bin"))
            .agg(
                F.count("*").alias("n"),
                *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)],
                *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)],
            )
        )
        nearest = Window.partitionBy("key").orderBy("bin")
        sums = sums.withColumn("before", F.sum("n").over(nearest) - F.col("n")).withColumn("rows", F.sum("n").over(Window.partitionBy("key")))
        core = sums.where(F.col("before") * 100 < F.col("rows") * CORE_PERCENT).groupBy("key").agg(
            F.max("rows").alias("rows"), F.sum("n").cast("double").alias("n"),
            *[F.sum(f"s{i}").alias(f"s{i}") for i in range(d)],
            *[F.sum(f"p{i}{j}").alias(f"p{i}{j}") for i in range(d) for j in range(i + 1)],
        )
        for i in range(d):
            core = core.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
            for j in range(i + 1):
                c = (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * factor
                core = core.withColumn(f"c{i}{j}", c + (FLOORS[i] * UNIT) ** 2 if i == j else c)
        found = scratch.save(_cholesky(core))
    return found


def judge(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", limit: float = LIMIT, keep_text: bool = False) -> DataFrame:
    """The columns of ``statistics`` (``doc`` without the text unless ``keep_text``) plus distance (of the group's estimate) and kept.

    Null text has no words and fails the base rules; null languages and sources are groups like any
    other; repeated rows each count; ties in distance share a bin; an empty table gives an empty
    one. Estimates rest on the texts that pass the base rules.
    """
    scratch = Scratch(docs.sparkSession, "rules")
    rows = statistics(docs, text)
    lang_key = F.to_json(F.struct(F.col(f"doc.`{lang}`").alias("l")), {"ignoreNullFields": "false"})
    both_key = F.to_json(F.struct(F.col(f"doc.`{lang}`").alias("l"), F.col(f"doc.`{source}`").alias("s")), {"ignoreNullFields": "false"})
    slim = [c for c in rows.schema["doc"].dataType.names if keep_text or c != text]
    rows = rows.withColumn("doc", F.struct(*[F.col(f"doc.`{c}`") for c in slim]))
    rows = scratch.save(rows.select("*", *vector(), F.array(both_key, lang_key, F.lit("")).alias("keys")))
    d = len(NAMES)
    x = [f"x{i}" for i in range(d)]
    spread = rows.where("NOT base_failed").select(F.explode("keys").alias("key"), *x)
    found = estimate(spread, scratch)
    big = found.where((F.col("rows") >= LEAST_ROWS) | (F.col("key") == ""))
    fields = [c for c in big.columns if c not in ("key", "rows")]
    for k in range(3):
        rows = _with_estimates(rows, big.select("key", F.struct(*fields).alias(f"e{k}")), F.col("keys")[k], "left")
    rows = rows.withColumn("e", F.coalesce("e0", "e1", "e2")).select(*[c for c in rows.columns if c[0] not in "ek" or c == "keys"], "e.*")
    distance = F.sqrt(_distance())
    rows = rows.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)
    own = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance")
    return rows.select("doc", *own, kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    return judge(docs).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
