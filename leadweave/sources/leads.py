"""Reading raw leads and saving typed companies."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadweave import schemas


def read_raw_leads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw leads under the declared contract: no inference, missing fields are NULL. Columns
    of a CSV table are found by the names in its header, in any order."""
    if fmt not in ("parquet", "json", "csv"):
        raise ValueError(f"unsupported format {fmt!r}")
    if fmt != "csv":
        return spark.read.schema(schemas.RAW_LEAD).format(fmt).load(path)
    text = spark.read.option("header", True).option("escape", '"').csv(path)
    return text.select(*[
        (F.col(f"`{f.name}`") if f.name in text.columns else F.lit(None)).try_cast(f.dataType).alias(f.name)
        for f in schemas.RAW_LEAD])


def valid_raw_leads(df: DataFrame) -> DataFrame:
    """Rows holding every required field of the contract."""
    return df.filter(" AND ".join(
        f"{c} IS NOT NULL" for c in ("company_name", "source", "source_url", "scraped_at")))


# Pipeline columns that never reach the table from a pipeline row.
_NOT_SAVED = {"id", "created_at", "updated_at", "is_duplicate_of", "task_id"}


def to_companies(leads: DataFrame, task_id: str) -> DataFrame:
    """Pipeline rows as company rows: text rating and time read as numbers and timestamps
    (NULL when unreadable, zone dropped), unknown columns left out, flags default to false."""
    def typed(field):
        name, kind = field.name, field.dataType
        if name not in leads.columns or name in _NOT_SAVED:
            return F.lit(None).cast(kind)
        col = F.col(name)
        if name == "rating":
            return col.cast("string").try_cast("double")
        if name == "scraped_at":
            return F.regexp_replace(col.cast("string"), r"(Z|[+-]\d{2}:?\d{2})$", "").try_cast(kind)
        if name in ("email_validated", "needs_review"):
            return F.coalesce(col, F.lit(False))
        return col.cast(kind)

    out = [typed(f).alias(f.name) for f in schemas.COMPANY]
    flags = [n for n in ("email_validated", "needs_review") if n not in leads.columns]
    saved = leads.select(*out).withColumns({
        "task_id": F.lit(task_id),
        "id": F.sha2(F.concat_ws("\u0001", F.lit(task_id), F.coalesce("pipeline_id", F.lit(""))), 256).substr(1, 36),
        "created_at": F.current_timestamp().cast("timestamp_ntz"),
        **{n: F.lit(False) for n in flags},
    })
    return saved.select(schemas.COMPANY.fieldNames())


def save_companies(companies: DataFrame, path: str) -> None:
    """Save the companies of tasks. A task that is run again replaces what it saved before; the
    files of other tasks stay as they are, and a run that fails changes nothing."""
    companies.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(path)
