"""Figures for dashboards over tasks and stage counters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves rounded up; 0 when there is nothing to divide by."""
    return F.when(whole > 0, F.floor(part / whole * 100 + 0.5)).otherwise(F.lit(0)).cast("bigint")


def dashboard_kpis(tasks: DataFrame) -> DataFrame:
    def total(name):
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    return tasks.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(F.col("status").isin("running", "pending")).alias("active_tasks"),
        F.count_if(F.col("status") == "completed").alias("completed_tasks"),
        total("total_scraped"), total("total_cleaned"), total("total_deduped"),
    ).withColumns({
        "duplicates_removed": F.col("total_scraped") - F.col("total_deduped"),
        "yield_pct": percent(F.col("total_deduped"), F.col("total_scraped")),
    })


def task_yield(tasks: DataFrame) -> DataFrame:
    """Yield of each task and whether it reaches 50 %."""
    return tasks.withColumn("yield_pct", percent(F.col("total_deduped"), F.col("total_scraped"))) \
        .withColumn("good_yield", F.col("yield_pct") >= 50)


def recent_tasks(tasks: DataFrame, n: int = 5) -> DataFrame:
    return task_yield(tasks).orderBy(F.col("created_at").desc(), F.col("id")).limit(n)


def last_completed(tasks: DataFrame) -> DataFrame:
    """The newest completed task, the smaller id on ties."""
    return tasks.filter("status = 'completed'").orderBy(F.col("created_at").desc(), F.col("id")).limit(1)


def stage_funnel(stats: DataFrame) -> DataFrame:
    """Change against the previous stage of the task and its colour. A task has one row per
    stage, so a window over a task is a handful of rows whatever the table size."""
    by_task = Window.partitionBy("task_id").orderBy("created_at", "step")
    before = F.lag("count_out").over(by_task)
    loss = F.abs(F.col("diff"))
    colour = (
        F.when(F.col("diff").isNull(), F.lit(None))
        .when((F.col("prev_out") == 0) | (loss == 0), "green")
        .when(loss / F.col("prev_out") >= 0.1, "red")
        .otherwise("yellow")
    )
    return stats.withColumn("prev_out", before) \
        .withColumn("diff", F.col("count_out") - F.col("prev_out")).withColumn("colour", colour)


def progress_pct(df: DataFrame, done: str = "pages_processed", total: str = "pages_total") -> DataFrame:
    """Percent done; without a total the bar is indeterminate and the percent 0."""
    known = F.coalesce(F.col(total) != 0, F.lit(False))
    return df.withColumns({
        "indeterminate": ~known,
        "percent": F.when(known, percent(F.col(done), F.col(total))).otherwise(F.lit(0).cast("bigint")),
    })
