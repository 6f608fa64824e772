"""Changes to stored tables that leave what they don't touch alone.

A table is a folder partitioned by one column. A change reads the touched partitions, writes what
becomes of them beside the table, and then swaps exactly these partitions in one overwrite: files
of other partitions stay as they are, and a change that fails before the swap leaves the table as
it was. The touched partitions are named by a list of their values, which is as long as the change
has partitions, not rows. Changes of one table are made one after the other."""

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave.operators.companies import apply_edits, check_edits
from leadweave.session import drop_folder, ensure_checkpoint_dir
from leadweave.sources.pages import upsert_pages


def replace_partitions(
    spark: SparkSession, path: str, by: str, touched: list, change: Callable[[DataFrame], DataFrame],
) -> None:
    """Put ``change`` of the touched partitions in their place. One that loses all rows goes."""
    if not touched:
        return
    table = spark.read.parquet(path)
    old = table.filter(F.col(by).isin(*touched))
    beside = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    try:
        change(old).select(table.columns).write.parquet(beside)
        staged = spark.read.schema(table.schema).parquet(beside)
        left = {str(r[0]) for r in staged.select(by).distinct().collect()}
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        emptied = {str(v) for v in touched} - left
        if emptied:
            # folders as the files name them; a value is escaped in the folder, a folder in the name
            folders = {unquote(name).rsplit("/", 1)[0] for name in table.inputFiles()}
            for folder in folders:
                column, _, value = folder.rsplit("/", 1)[1].partition("=")
                if column == by and unquote(value) in emptied:
                    drop_folder(spark, folder)
    finally:
        drop_folder(spark, beside)


def commit_upsert(spark: SparkSession, path: str, new_pages: DataFrame) -> None:
    """``upsert_pages`` on a page store partitioned by source."""
    columns = spark.read.parquet(path).columns
    touched = [r[0] for r in new_pages.select("source").distinct().collect()]
    replace_partitions(spark, path, "source", touched, lambda old: upsert_pages(old, new_pages.select(columns)))


def commit_purge(spark: SparkSession, path: str, source: str | None = None) -> int:
    """Remove the pages of a source, or all. Returns how many there were."""
    table = spark.read.parquet(path)
    doomed = table if source is None else table.filter(F.col("source") == source)
    found = doomed.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
    replace_partitions(spark, path, "source", [r[0] for r in found], lambda old: old.limit(0))
    return sum(r["n"] for r in found)


def commit_edits(spark: SparkSession, path: str, edits: DataFrame, edited_at=None) -> None:
    """``apply_edits`` on a company table partitioned by task. Unknown ids and fields are refused
    before anything is written."""
    companies = spark.read.parquet(path)
    check_edits(edits, companies)
    ids = edits.select("id").distinct()
    touched = [r[0] for r in companies.select("id", "task_id").join(ids, "id", "left_semi").select("task_id").distinct().collect()]
    replace_partitions(spark, path, "task_id", touched, lambda old: apply_edits(old, edits, edited_at))


def commit_reset(spark: SparkSession, path: str, task_ids: list[str]) -> None:
    """Remove the companies of tasks."""
    there = {r[0] for r in spark.read.parquet(path).select("task_id").distinct().collect()}
    replace_partitions(spark, path, "task_id", [t for t in task_ids if t in there], lambda old: old.limit(0))
