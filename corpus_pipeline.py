"""Documents to a training mix, in stages of the operators in ``leadweave.llm``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.llm import decontamination, line_dedup, mixing, quality_attention, simhash
from leadweave.llm.queries import TARGETS, domain_labels
from leadweave.session import ensure_checkpoint_dir, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents scored below one half go."""
    return quality_attention.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: boilerplate lines of a source go; n_chars follows the text."""
    return line_dedup.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document of the least doc_id of every SimHash component stays."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents of which a twentieth or more is benchmark text go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: domain, rate and copies of every document. The token budget is the least
    that asks no domain to give up documents: scarce domains are repeated instead."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.apply_mix(docs, domain_labels(docs, labels), TARGETS, keep_all=True)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: Model scores and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's output is written and read again."""
    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
