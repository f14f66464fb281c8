"""The log of a Bronze table's runs: one small file per append, whose name holds the version and the run.

A version is claimed by creating an empty file, which only one of two writers can do, so runs are numbered in the order in
which they were committed and no reader has to look at the data, or order all runs, to number them.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engagelake.sources.files import exists, hadoop_path

SCHEMA = "version long, _run_id string, first_ingested_at timestamp, last_ingested_at timestamp, rows long"
CLAIMS = "_claims"


def versions(spark: SparkSession, folder: str) -> dict[str, int]:
    """The version of every committed run, by its quoted name, from the names of the files alone."""
    fs, target = hadoop_path(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
    parts = [n.removesuffix(".json").split("-", 1) for n in names if n[:1].isdigit()]
    return {rest.rsplit("-", 1)[0]: int(number) for number, rest in parts}


def _create(spark: SparkSession, path: str) -> bool:
    """Create an empty file in one step; False where it is there already."""
    fs, target = hadoop_path(spark, path)
    if fs.getScheme() == "file":  # Hadoop's own local files look first and create then
        fs.mkdirs(target.getParent())
        return spark._jvm.java.io.File(target.toUri().getPath()).createNewFile()
    try:
        fs.create(target, False).close()
        return True
    except Py4JJavaError as error:
        if not fs.exists(target):
            raise error
        return False


def _claim(spark: SparkSession, folder: str, number: int) -> int:
    """The first version from ``number`` on that nobody has."""
    while not _create(spark, f"{folder}/{CLAIMS}/{number:012d}"):
        number += 1
    return number


def _stamp(at: datetime) -> str:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return at.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def commit(spark: SparkSession, folder: str, run_id: str, first: datetime, last: datetime, rows: int, entry: str | None = None) -> int:
    """Record one append of a run; its version. The same ``entry`` of a run, committed again, replaces itself."""
    known, name = versions(spark, folder), quote(run_id, safe="")
    number = known[name] if name in known else _claim(spark, folder, max(known.values(), default=-1) + 1)
    line = {"version": number, "_run_id": run_id, "first_ingested_at": _stamp(first), "last_ingested_at": _stamp(last), "rows": rows}
    fs, target = hadoop_path(spark, f"{folder}/{number:012d}-{name}-{entry or uuid.uuid4().hex}.json")
    out = fs.create(target, True)
    out.write(bytearray((json.dumps(line) + "\n").encode()))
    out.close()
    return number


def history(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run: version (0 first), first and last ingest time, rows. Reads the log alone."""
    if not exists(spark, folder):
        return spark.createDataFrame([], SCHEMA).select("_run_id", "first_ingested_at", "last_ingested_at", "rows", "version")
    entries = spark.read.schema(SCHEMA).json(folder)
    return entries.groupBy("_run_id", "version").agg(
        F.min("first_ingested_at").alias("first_ingested_at"), F.max("last_ingested_at").alias("last_ingested_at"),
        F.sum("rows").alias("rows")).select("_run_id", "first_ingested_at", "last_ingested_at", "rows", "version")
