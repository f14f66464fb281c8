"""The layered lake: append-only Bronze with as-of reads, overwritten Silver and Gold."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engagelake.config import LakeConfig
from engagelake.schemas import CONTRACTS, conform, encode_nested
from engagelake.session import BROADCAST_ROWS
from engagelake.sources import runlog
from engagelake.sources.files import drop_versions, exists, read_pointer, write_pointer

BRONZE = ("profiles", "posts", "reels")


def new_run_id() -> str:
    """Time and eight random digits."""
    return f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"


def with_ingestion(df: DataFrame, run_id: str, source: str = "scrape", now: datetime | None = None) -> DataFrame:
    """Lineage columns; one literal time for the whole batch."""
    stamp = now or datetime.now(timezone.utc)
    return df.withColumns(
        {"_ingested_at": F.lit(stamp).cast("timestamp"), "_run_id": F.lit(run_id), "_source": F.lit(source)}
    )


def run_history(df: DataFrame, run: str = "_run_id", at: str = "_ingested_at") -> DataFrame:
    """One row per run of a table without a log: version (0 first), first and last ingest time, rows."""
    runs = df.groupBy(run).agg(
        F.min(at).alias("first_ingested_at"), F.max(at).alias("last_ingested_at"), F.count(F.lit(1)).alias("rows")
    )
    order = Window.orderBy("first_ingested_at", run)  # one row per run
    return runs.withColumn("version", (F.row_number().over(order) - 1).cast("bigint"))


def as_of(
    df: DataFrame,
    version: int | None = None,
    timestamp: datetime | str | None = None,
    run: str = "_run_id",
    at: str = "_ingested_at",
) -> DataFrame:
    """Append-only rows as they were after run number ``version``, or at a time; the version wins."""
    if version is not None:
        runs = run_history(df, run, at).where(F.col("version") <= version).select(run)
        return df.join(runs, run, "left_semi")
    if timestamp is not None:
        return df.where(F.col(at) <= F.lit(timestamp).cast(df.schema[at].dataType))
    raise ValueError("give a version or a timestamp")


class Lake:
    def __init__(self, spark: SparkSession, config: LakeConfig | None = None):
        self.spark = spark
        self.config = config or LakeConfig()

    def path(self, layer: str, name: str) -> str:
        return f"{self.config.layer(layer)}/{name}"

    def has(self, layer: str, name: str) -> bool:
        path = self.path(layer, name)
        if layer == "bronze" or self.config.table_format == "delta":
            return exists(self.spark, path)
        return read_pointer(self.spark, path) is not None

    # Bronze

    def append(
        self, entity: str, raw: DataFrame, run_id: str | None = None, source: str = "scrape", now: datetime | None = None
    ) -> tuple[str, int]:
        """Append a batch under a run id; returns the run id and the number of rows stored, read back."""
        if entity not in BRONZE:
            raise ValueError(f"unknown entity {entity!r}")
        if raw.isEmpty():
            raise ValueError(f"no data to append to bronze {entity}")
        run_id = run_id or str(uuid.uuid4())
        stamp = now or datetime.now(timezone.utc)
        batch = conform(with_ingestion(encode_nested(raw), run_id, source, stamp), CONTRACTS[f"bronze_{entity}"])
        writer = batch.write.mode("append").format(self.config.table_format)
        writer.partitionBy("_run_id").save(self.path("bronze", entity))
        stored = self.bronze(entity).where((F.col("_run_id") == run_id) & (F.col("_ingested_at") == F.lit(stamp))).count()
        self.log_run(entity, run_id, stamp, stamp, stored)
        return run_id, stored

    def adopt(self, entity: str, stamped: DataFrame) -> int:
        """Append rows that carry their lineage (``_run_id``, ``_ingested_at``), as from another lake; the runs logged.

        Runs get versions in the order of their first time. The driver sees one row per run.
        """
        contract = CONTRACTS[f"bronze_{entity}"]
        if "_source" not in stamped.columns:
            stamped = stamped.withColumn("_source", F.lit("adopted"))
        ready = conform(encode_nested(stamped), contract)
        ready.write.mode("append").format(self.config.table_format).partitionBy("_run_id").save(self.path("bronze", entity))
        return self.reindex(entity)

    def runs_folder(self, entity: str) -> str:
        return f"{self.config.layer('bronze')}/runs/{entity}"

    def log_run(self, entity: str, run_id: str, first: datetime, last: datetime, rows: int, entry: str | None = None) -> None:
        """Commit an append to the log, after its rows are there. Delta tables keep a log of their own."""
        if self.config.table_format != "delta":
            runlog.commit(self.spark, self.runs_folder(entity), run_id, first, last, rows, entry)

    def reindex(self, entity: str) -> int:
        """Log the runs of a Bronze table that the log does not have: written before there was one, or by a job that failed."""
        known = runlog.versions(self.spark, self.runs_folder(entity))
        runs = run_history(self.bronze(entity)).orderBy("version").collect()
        todo = [r for r in runs if quote(r["_run_id"], safe="") not in known]
        for r in todo:
            self.log_run(entity, r["_run_id"], r["first_ingested_at"], r["last_ingested_at"], r["rows"])
        return len(todo)

    def bronze(self, entity: str) -> DataFrame:
        """All rows of all runs. The contract is the read schema, so files written before a column was added fit."""
        path = self.path("bronze", entity)
        if not exists(self.spark, path):
            raise FileNotFoundError(f"no bronze table at {path}: run the bronze job first")
        reader = self.spark.read.format(self.config.table_format)
        if self.config.table_format == "delta":
            return reader.load(path)
        return reader.schema(CONTRACTS[f"bronze_{entity}"]).load(path).select(*CONTRACTS[f"bronze_{entity}"].names)

    def bronze_at(self, entity: str, version: int | None = None, timestamp: datetime | str | None = None) -> DataFrame:
        if version is None and timestamp is None:
            raise ValueError("give a version or a timestamp")
        if self.config.table_format == "delta":
            option = ("versionAsOf", version) if version is not None else ("timestampAsOf", str(timestamp))
            return self.spark.read.format("delta").option(*option).load(self.path("bronze", entity))
        rows, runs = self.bronze(entity), self.history(entity)
        if version is not None:
            runs = runs.where(F.col("version") <= version)
        else:
            at = F.lit(timestamp).cast("timestamp")
            rows, runs = rows.where(F.col("_ingested_at") <= at), runs.where(F.col("first_ingested_at") <= at)
        # The log is read, not the table: its runs prune the partitions of the table when the query runs.
        few = len(runlog.versions(self.spark, self.runs_folder(entity))) <= BROADCAST_ROWS
        return rows.join(F.broadcast(runs.select("_run_id")) if few else runs.select("_run_id"), "_run_id", "left_semi").select(*rows.columns)

    def history(self, entity: str) -> DataFrame:
        """One row per run, from the log; a table without a log is indexed first."""
        if self.config.table_format == "delta":
            return run_history(self.bronze(entity))
        folder = self.runs_folder(entity)
        if not exists(self.spark, folder):
            self.reindex(entity)
        return runlog.history(self.spark, folder)

    # Silver and Gold

    def replace(self, layer: str, name: str, df: DataFrame) -> int:
        """Write a new version beside the old one, then point at it: a job that fails at any step leaves the old table."""
        schema = CONTRACTS[f"{layer}_{name}"]
        ready = conform(df, schema)
        path = self.path(layer, name)
        if self.config.table_format == "delta":
            ready.write.format("delta").mode("overwrite").option("overwriteSchema", True).save(path)
            return self.table(layer, name).count()
        before = read_pointer(self.spark, path)
        after = f"v-{uuid.uuid4().hex}"
        ready.write.format(self.config.table_format).save(f"{path}/{after}")
        write_pointer(self.spark, path, after)
        # Readers that opened the table before this run still hold its last version; older ones go.
        drop_versions(self.spark, path, {before, after})
        return self.table(layer, name).count()  # from the file footers

    def table(self, layer: str, name: str) -> DataFrame:
        path = self.path(layer, name)
        if not self.has(layer, name):
            raise FileNotFoundError(f"no {layer} table at {path}: run the jobs first")
        current = read_pointer(self.spark, path)
        return self.spark.read.format(self.config.table_format).load(f"{path}/{current}" if current else path)

    # Facade

    def load(self, name: str) -> DataFrame:
        """profiles, posts, reels, comments (scored if there are any, else clean), clusters, topics."""
        homes = {
            "profiles": [("gold", "engagement")],
            "posts": [("silver", "posts")],
            "reels": [("silver", "reels")],
            "comments": [("gold", "sentiment"), ("silver", "comments")],
            "clusters": [("gold", "clusters")],
            "topics": [("gold", "topics")],
        }
        if name not in homes:
            raise ValueError(f"unknown table {name!r}")
        for layer, table in homes[name]:
            if self.has(layer, table):
                return self.table(layer, table)
        layer, table = homes[name][-1]
        raise FileNotFoundError(f"no {layer} table {table} under {self.config.data_root}: run the jobs first")

    def views(self) -> list[str]:
        """Temporary views for every table that is there, for SQL users."""
        made = []
        for name in ("profiles", "posts", "reels", "comments", "clusters", "topics"):
            try:
                self.load(name).createOrReplaceTempView(name)
                made.append(name)
            except FileNotFoundError:
                continue
        return made
