"""Session settings the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings. Partition counts are left to AQE, which starts from
# spark.sql.shuffle.partitions and merges or splits from there.
RUNTIME_CONF = {
    # Small files are opened by more tasks; of no effect once a task's share is larger than this.
    "spark.sql.files.openCostInBytes": str(1 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot never compiles a method above 8000 bytecodes; wide projections then run
    # interpreted. Above this limit Spark falls back to split, compilable functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Sizes that a task's memory follows; a session that has set less keeps its own.
MOST_BYTES = {
    "spark.sql.files.maxPartitionBytes": 16 << 20,  # rows that partial aggregates of one task may hold
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,  # AQE merges partitions up to this; a row takes ten times as much in a hash map
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,  # a batch is held in both the JVM and its Python worker
}

# Settings only a new session can take.
STARTUP_CONF = {
    # Call-site capture doubles the driver's work on plans with hundreds of expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every operator assumes; safe to call repeatedly."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    for key, most in MOST_BYTES.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


def session(app_name: str = "assayer", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**RUNTIME_CONF, **STARTUP_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for ``DataFrame.checkpoint``.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder; elsewhere a missing setting is an error,
    because a machine-local folder is lost together with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate once as Parquet to the checkpoint folder and read it back from there.

    For results several later steps read: unlike a cache it takes no executor memory and survives the loss of executors, and
    later steps prune its columns and know its size. The files stay until ``release`` or the end of the folder itself.
    """
    spark = df.sparkSession
    path = f"{_intermediates(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _intermediates(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/intermediates"


def release(spark: SparkSession) -> None:
    """Delete what ``materialise`` has written in this session; frames built on it can no longer be read."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_intermediates(spark))
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
