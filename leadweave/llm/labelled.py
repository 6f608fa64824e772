"""Training rows for the classifiers: bounded, labelled, from the folds that may be seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.operators.key_filter import key_filter


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % folds


def held_out(doc_id: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold(doc_id, folds) == which, F.lit(False))


def usable_labels(labels: DataFrame, label_col: str, folds: int, which: int) -> DataFrame:
    """doc_id and _label of labelled ids outside the held-out fold. Rows without id or label are
    no labels; of several for one id the greatest counts."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (fold(F.col("doc_id"), folds) != which))
    return usable.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_label"))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, which: int, text_col: str = "text") -> DataFrame:
    """(text, label) of every labelled document outside the held-out fold. A Bloom filter of the
    labelled ids drops the other texts where they are read; the rest are merged with the labels
    in one way at every size."""
    known = usable_labels(labels, label_col, folds, which)
    given = docs.select("doc_id", F.col(text_col).alias("text")).filter(key_filter(known, F.col("doc_id"))(F.col("doc_id")))
    return given.join(known.hint("merge"), "doc_id").select("text", F.col("_label").alias("label"))


def training_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, folds: int, which: int, limit: int, text_col: str = "text",
) -> DataFrame:
    """(text, label) of at most ``limit`` labelled documents outside the held-out fold, the
    first in order of a hash of the id. The ids are bounded by ``limit``, so they are broadcast
    to the documents."""
    ids = usable_labels(labels, label_col, folds, which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select(
        "doc_id", "text", F.col("_label").alias("label"))
