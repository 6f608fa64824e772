"""Session defaults and the one place where lineage is cut."""

import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(master: str | None = None, app: str = "leadweave", **conf) -> SparkSession:
    """A session with the settings the operators were tuned for.

    Shuffle partitions stay a starting point: adaptive execution coalesces small ones and
    splits skewed ones. On a cluster pass ``spark.sql.shuffle.partitions`` sized so that a
    partition holds 100-200 MB and set ``spark.checkpoint.dir`` to a shared folder.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers (as ``--py-files`` would), once per
    application, so that kernels can be unpickled wherever the job runs from."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="leadweave-package-")) / "leadweave.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted(root.rglob("*.py")):
                archive.write(source, source.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)
    return spark


def one_machine(master: str) -> bool:
    """Whether driver and tasks are one process; a ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the cluster's ``spark.checkpoint.dir`` if set. Only a local-mode
    session may fall back to a temporary folder; on a cluster that would not survive the
    loss of an executor, so it is an error."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not one_machine(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="leadweave-checkpoint-")
    context.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this application wrote, wherever it is stored."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def even_parts(spark: SparkSession) -> int:
    """How many parts of equal size keep every core busy to the end: several for each core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by a hash of ``keys``, for costly work row by row. A Parquet file of few
    megabytes can hold millions of rows; read as it lies, it is the work of one or two tasks."""
    return df.repartition(even_parts(df.sparkSession), *keys)


@contextmanager
def compiled_rules(spark: SparkSession) -> Iterator[None]:
    """Run long row rules as methods that the JVM compiles. It interprets methods beyond 8,000
    bytes for good; with this limit Spark writes such rules as several shorter ones."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


_STORED: dict[tuple[str, str, str], str] = {}


def stored_path(spark: SparkSession, name: str, origin: str, build: Callable[[], DataFrame]) -> str:
    """Folder of a Parquet table under the checkpoint folder, written on first use in an
    application."""
    key = (spark.sparkContext.applicationId, name, origin)
    if key not in _STORED:
        mark = hashlib.md5(origin.encode()).hexdigest()[:8]
        path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{mark}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _STORED[key] = path
    return _STORED[key]


def stored_table(
    spark: SparkSession, name: str, origin: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """``stored_path`` read back, with column pruning and filter pushdown as for any table."""
    return spark.read.parquet(stored_path(spark, name, origin, build))


_ROW_NAMES = ("ord", "pipeline_id", "event_seq", "rep")


def row_hash(df: DataFrame) -> Column:
    """A hash of what names a row; of the whole row where nothing does. It stays with the row when
    a lost task is run again, however its rows arrive then."""
    named = [c for c in _ROW_NAMES if c in df.columns][:1]
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[F.col(f"`{c}`") for c in named or plain])


def salted_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a side whose keys may be hot to one of a row per key. The big side's rows of a key
    are dealt to ``salts`` partitions by ``row_hash``, the small side is repeated once for each;
    rows without a key match nothing and are dealt out evenly."""
    row = row_hash(big)
    salt = F.when(F.col(key).isNull(), -1 - F.pmod(row, F.lit(65536))).otherwise(F.pmod(row, F.lit(salts)))
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return big.withColumn("_salt", salt).join(many, ["_salt", key], how).drop("_salt")
