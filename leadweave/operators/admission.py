"""What happens to every batch before the first stage: admission and row identity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit(df: DataFrame) -> DataFrame:
    """Keep rows with a company name (blank-only names pass) and read phones as text."""
    kept = df.filter(F.col("company_name") != "")
    if "phone" in kept.columns:
        kept = kept.withColumn("phone", F.col("phone").cast("string"))
    return kept


def with_pipeline_id(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Keep a given ``pipeline_id``; otherwise derive one from the key columns, so that a
    retried task assigns the same id again."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in key_cols]
    derived = F.sha2(F.concat_ws("\u0001", *fields), 256)
    if "pipeline_id" in df.columns:
        derived = F.coalesce(F.col("pipeline_id"), derived)
    return df.withColumn("pipeline_id", derived)
