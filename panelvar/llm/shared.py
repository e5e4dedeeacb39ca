"""What the operators of this folder share: words, the shared scratch folder, tables in it."""

from __future__ import annotations

import gc
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelvar.session import ensure_checkpoint_dir

#: White space between words: space and the five ASCII controls from tab to carriage return.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word, as a pattern for Java and for Python.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; none for null or for white space alone."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(inner) > 0, F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of ``words``: each becomes one letter, so no array of a text's words is built to be counted."""
    marks = F.regexp_replace(F.btrim(text, F.lit(SPACE)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("bigint")


def without_space(text: Column) -> Column:
    return F.translate(text, SPACE, "")


def input_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of one column over all rows."""
    return df.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0


def parallelism(spark: SparkSession, size: int = 0, per_task: int = 32 << 20) -> int:
    """At least the session's shuffle partitions; more where ``size`` bytes need more tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / per_task), 1)


class Scratch:
    """Intermediate tables in the folder that the session names in ``spark.checkpoint.dir``.

    A written table cuts lineage: later jobs read files that every executor sees, so a lost
    executor costs only the tasks that it ran. ``drop`` removes a table that nothing reads again;
    ``save`` with ``free`` also lets
    Spark's cleaner delete the shuffle files of plans that are no longer in use. ``codec`` compresses
    the tables otherwise than the session's setting: zstd where they hold whole texts for long.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str | None = None):
        self.spark = spark
        self.options = {"compression": codec} if codec else {}
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, drop: tuple[DataFrame, ...] = (), free: bool = True) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        df.write.options(**self.options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        for old in drop:
            self.drop(old)
        if free:
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
