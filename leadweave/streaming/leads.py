"""Raw leads as a stream: every row rule on every column, and a save that can be replayed."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from leadweave.plans.pipeline import prepare
from leadweave.session import ensure_checkpoint_dir


def read_raw(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """File stream of raw lead tables."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def prepared(raw: DataFrame, id_col: str = "lead_id", **tables: DataFrame) -> DataFrame:
    """Admitted, identified, cleaned and validated leads of a stream. ``tables`` (mail_domains,
    verdicts, area_codes) are static and joined as in batch: no state is kept."""
    return prepare(raw, id_col, **tables)


def save_batches(leads: DataFrame, path: str, checkpoint: str) -> None:
    """Save what is there now. Every micro-batch owns the folder of its number and replaces what
    stands there, so a batch that is run again adds no row. Folder -1 holds no rows: it is there
    for streams that have none."""
    leads.sparkSession.createDataFrame([], leads.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    leads.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def saved(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def drain_leads(leads: DataFrame, base: str | None = None) -> DataFrame:
    """Save a stream of leads under the shared checkpoint folder and read them back."""
    base = base or f"{ensure_checkpoint_dir(leads.sparkSession)}/leads-{uuid.uuid4().hex}"
    save_batches(leads, f"{base}/rows", f"{base}/state")
    return saved(leads.sparkSession, f"{base}/rows", leads.schema)
