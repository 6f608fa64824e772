"""Run a stream over what is there now and hand back the result as a table."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from leadweave.session import ensure_checkpoint_dir

#: The state store that keeps state with a time to live. A run over what is there
#: ends with it: without new messages no further batch is made to look for state that has expired.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """Queries started inside have these settings; a running query keeps its own."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def drain(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Process everything available into a Parquet table under the shared checkpoint folder,
    which also holds the stream's own checkpoint; read the table back. Given the ``base`` folder
    of an earlier run, go on where that one stopped."""
    spark = stream.sparkSession
    base = base or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    with stream_settings(spark):
        writer.format("parquet").option("path", f"{base}/rows").outputMode("append").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
