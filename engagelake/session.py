"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that may be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job of this package counts on."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    if sc.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # The default suits a cluster; stateful streams keep it as their number of state stores.
        spark.conf.set("spark.sql.shuffle.partitions", str(sc.defaultParallelism))
    return spark


def get_spark(app_name: str = "engagelake", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; keyword names use ``__`` for dots, e.g. ``spark__ui__enabled``."""
    builder = SparkSession.builder.appName(app_name)
    # Checkpoint files go when nothing refers to them any more.
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    # Remembering the Python line of every expression costs two more calls to the JVM for each.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; a temporary one only on a local master."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read on from there (survives lost executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read again.

    For tables that are made again and again in a loop: what is read knows nothing of how it was made, so plans and
    planning stay as small as in the first round.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a summary table once and count it: a broadcast side up to ``limit`` rows, a plain one beyond."""
    stored = cut_lineage(df)
    return F.broadcast(stored) if stored.count() <= limit else stored
