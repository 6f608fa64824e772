"""Exports of finished leads."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leadweave import schemas

# Exported columns, in order.
EXPORT_COLUMNS = [
    "company_name", "phone", "email", "website", "address", "city", "state", "zip",
    "category", "rating", "review_count", "source",
]
FORMATS = ("csv", "json")


def export_rows(companies: DataFrame, task_id: str) -> DataFrame:
    """A task's companies without the rows marked as duplicates."""
    return companies.filter((F.col("task_id") == task_id) & F.col("is_duplicate_of").isNull()) \
        .select(EXPORT_COLUMNS)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header; the byte order mark rides on the first header name."""
    first = EXPORT_COLUMNS[0]
    df.select(EXPORT_COLUMNS).withColumnRenamed(first, "\ufeff" + first) \
        .write.mode("overwrite").option("header", True).option("emptyValue", "") \
        .option("quote", '"').option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """JSON Lines with every column present, non-ASCII as it is."""
    df.select(EXPORT_COLUMNS).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def run_export(
    spark: SparkSession, tasks: DataFrame, companies: DataFrame, task_id: str, fmt: str, path: str
) -> DataFrame:
    """Write one export and return its log row, counted while writing."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    if tasks.filter(F.col("id") == task_id).isEmpty():
        raise LookupError(f"task not found: {task_id}")
    watch = Observation("export")
    rows = export_rows(companies, task_id).observe(watch, F.count(F.lit(1)).alias("n"))
    (export_csv if fmt == "csv" else export_json)(rows, path)
    return log_row(spark, task_id, fmt, path, watch.get["n"])


def log_row(spark: SparkSession, task_id: str, fmt: str, path: str, rows: int) -> DataFrame:
    base = spark.createDataFrame([(task_id, fmt, path, rows)],
                                 "task_id string, format string, file_path string, rows_exported bigint")
    return base.withColumns({
        "id": F.uuid(), "exported_at": F.current_timestamp().cast("timestamp_ntz"),
    }).select(schemas.EXPORT_LOG.fieldNames())


def log_export(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
