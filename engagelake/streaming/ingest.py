"""Incremental Bronze ingest."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engagelake.schemas import CONTRACTS, conform, encode_nested
from engagelake.sources.lake import Lake, with_ingestion


def stream_json(lake: Lake, entity: str, folder: str, max_files: int = 1000) -> DataFrame:
    """New JSON files of a folder as a stream, with the Bronze contract (lineage aside) as schema."""
    schema = CONTRACTS[f"bronze_{entity}"]
    body = type(schema)([f for f in schema if not f.name.startswith("_")])
    reader = lake.spark.readStream.schema(body).option("multiLine", True).option("maxFilesPerTrigger", max_files)
    return reader.json(folder)


def query_id(batch: DataFrame) -> str:
    """The persistent id of the streaming query that a micro-batch belongs to."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def ingest_stream(
    lake: Lake, entity: str, stream: DataFrame, checkpoint: str, run_prefix: str = "stream", source: str = "scrape"
) -> StreamingQuery:
    """Append what has arrived, then stop.

    A micro-batch owns the run ``<prefix>-<query id>-<number>`` and replaces that partition when it is replayed, so every
    file lands exactly once. The query id lives in the checkpoint: another stream into the same entity, or one whose
    checkpoint was lost, has runs of its own and never touches what is there.
    """
    contract = CONTRACTS[f"bronze_{entity}"]
    path = lake.path("bronze", entity)

    def write(batch: DataFrame, number: int) -> None:
        run = f"{run_prefix}-{query_id(batch)}-{number:08d}"
        now = datetime.now(timezone.utc)
        stamped = with_ingestion(encode_nested(batch), run, source, now)
        writer = conform(stamped, contract).write.format(lake.config.table_format).mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("_run_id").save(path)
        lake.log_run(entity, run, now, now, lake.bronze(entity).where(F.col("_run_id") == run).count(), entry="batch")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
