"""JSON, CSV and Parquet files."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engagelake.schemas import quoted


def hadoop_path(spark: SparkSession, path: str):
    """File system and path object for any URI Spark can reach."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = hadoop_path(spark, path)
    return fs.exists(target)


# A table that is replaced as a whole keeps each version in a folder of its own; empty files named after the versions,
# numbered, say which is current. Creating such a file is one step on file systems and object stores alike.
POINTERS = "_current"


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    fs, folder = hadoop_path(spark, f"{path}/{POINTERS}")
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted((int(n.split("-", 1)[0]), n.split("-", 1)[1]) for n in names if n[:1].isdigit())


def read_pointer(spark: SparkSession, path: str) -> str | None:
    """The current version of a table, or None where there is none."""
    found = _pointers(spark, path)
    return found[-1][1] if found else None


def write_pointer(spark: SparkSession, path: str, version: str) -> None:
    found = _pointers(spark, path)
    fs, target = hadoop_path(spark, f"{path}/{POINTERS}/{found[-1][0] + 1 if found else 0:08d}-{version}")
    fs.create(target, True).close()


def drop_versions(spark: SparkSession, path: str, keep: set[str | None]) -> None:
    """Remove all versions but those to keep, and what points at them."""
    for number, version in _pointers(spark, path):
        if version not in keep:
            for name in (f"{POINTERS}/{number:08d}-{version}", version):
                fs, target = hadoop_path(spark, f"{path}/{name}")
                fs.delete(target, True)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True, check: bool = True
) -> DataFrame:
    """JSON arrays (or one object per line) with a declared schema; nested values land in text columns as JSON.

    A missing path and unreadable JSON are different errors. ``check`` reads the first record at once; later
    ones fail the job that reads them.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"no file at {path}")
    df = spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    if check:
        try:
            df.limit(1).collect()
        except (PySparkException, Py4JJavaError) as error:
            raise ValueError(f"invalid JSON in {path}: {error}") from error
    return df


def write_json(df: DataFrame, path: str) -> None:
    """UTF-8 JSON lines; non-ASCII text is kept as it is."""
    df.write.mode("overwrite").json(path)


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def seed_links(df: DataFrame, column: str = "Link") -> DataFrame:
    """Distinct trimmed links of a seed table."""
    links = strip_headers(df).select(F.trim(quoted(column)).alias(column))
    return links.where(quoted(column).isNotNull()).distinct()


def read_seeds(spark: SparkSession, path: str, column: str = "Link", fmt: str = "csv") -> DataFrame:
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return seed_links(reader.format(fmt).load(path), column)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def save_tables(tables: dict[str, DataFrame], root: str, prefix: str = "") -> dict[str, str]:
    """One Parquet table per name under ``root``; any URI, object stores included."""
    written = {}
    for name, df in tables.items():
        written[name] = f"{root.rstrip('/')}/{prefix}{name}"
        df.write.mode("overwrite").parquet(written[name])
    return written


def load_table(spark: SparkSession, root: str, name: str, prefix: str = "") -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{prefix}{name}")
