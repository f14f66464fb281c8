"""What the corpus operators share: settings, the query registry, word patterns, working folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engagelake.session import configure, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word: a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch; texts are long, and a worker holds one batch at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def settings(spark: SparkSession) -> SparkSession:
    """The session settings of the package, and Arrow batches small enough for long texts."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, folder) -> DataFrame`` with its SQL twin."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(settings(spark), folder.rstrip("/"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below the checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def in_blocks(rows: DataFrame, group: str, size: str, node: str, block: int, shared: int) -> DataFrame:
    """Deal the rows of every group for comparison with each other: adds ``own``, ``grp`` and ``pair``.

    A group above ``block`` rows is cut into blocks, and each pair of its blocks is one ``grp`` (``pair``: of two
    different blocks; ``own`` tells them apart). Groups up to ``block`` share ``grp``s of about ``2 * block`` rows;
    ``shared`` is the number of their rows. No ``grp`` grows with the data.
    """
    buckets = max(1, -(-shared // (2 * block)))
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    bucket = F.concat(F.lit("s"), F.pmod(F.xxhash64(group), F.lit(buckets)))
    pair = F.concat_ws("|", F.col(group).cast("string"), F.least("own", "__other"), F.greatest("own", "__other"))
    return dealt.withColumn("grp", F.when(F.col(size) <= block, bucket).otherwise(pair)).withColumn(
        "pair", F.col("own") != F.col("__other")).drop("__other")


def words_of(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit(*key: Column) -> Column:
    """A uniform number in (0, 1) drawn from the hash of ``key``."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
