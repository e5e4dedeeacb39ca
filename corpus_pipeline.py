"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, packing.

Each stage takes the documents that the one before kept, applies one operator to all of them and
returns the columns of documents; the last returns pieces with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelvar.llm import lines, mixing, near, packing, rules
from panelvar.llm.shared import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Rows alike in all columns have one verdict."""
    return rules.judge(docs, keep_text=True).where("kept").select("doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text."""
    out = lines.drop_lines(docs).select("doc.*")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")) if "n_chars" in out.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id."""
    return near.near_duplicates(docs).where("kept").select("doc.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    mixed = mixing.mix(docs).where("times > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), "times"))).select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with checksums of their ids and places in sequences of 1024 tokens."""
    return packing.pack(docs, packing.public_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Estimates by concentration steps, sketches and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.save(docs)
    return docs
