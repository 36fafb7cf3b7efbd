"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType

# Runtime settings only: safe to apply to a session somebody else created.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A lookup key that holds a large share of the fact makes one join partition
    # huge; this splits it even where that costs a later exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Same for the partitions of a rebalance before a partitioned write.
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Tables in thousands of parts are listed by so many tasks, not by one for each part.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in TUNING.items():
        spark.conf.set(name, value)
    return spark


# A shuffle partition should fit in a task's memory.
PARTITION_BYTES = 256 << 20
# Adaptive execution joins small partitions up to this size, which is compressed: in a task it is many times that.
JOINED_BYTES = 32 << 20


def size_shuffles(spark: SparkSession, input_bytes: int) -> int:
    """Shuffle partitions for the largest input; small shuffles are coalesced at run time.

    Never below what the session is configured for.
    """
    wanted = math.ceil(input_bytes / PARTITION_BYTES)
    partitions = max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(JOINED_BYTES))
    return partitions


def local_session(cpus: int | str = 8, app: str = "tradewell", **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        # Recording the source line of every column call costs more than the call.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in extra.items():
        builder = builder.config(name.replace("__", "."), value)
    return tune(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the
    executors do not share one, so a missing setting is an error there.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    existing = context.getCheckpointDir()
    if existing:
        return existing
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tradewell-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def stored_columns(df: DataFrame, name: str) -> DataFrame:
    """The rows as compressed columns of the shared folder: a checkpoint of wide rows would take several times the disk.

    As after a checkpoint, the lineage ends and nothing is computed twice. A column of no type cannot be stored so.
    """
    folder = ensure_checkpoint_dir(df.sparkSession)
    if any(isinstance(f.dataType, NullType) for f in df.schema):
        return df.checkpoint()
    path = f"{folder.rstrip('/')}/tradewell/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
