"""Descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.operators.ordering import BLOCK_ROWS, exact_quantiles, null_safe_join, sketched
from engagelake.schemas import quoted
from engagelake.session import written

STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
_QUARTILES = {0.25: "25%", 0.5: "50%", 0.75: "75%"}


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, non-null count, null share. One pass over the data."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.col(f"n{i}").alias("non_null"),
            (1 - F.col(f"n{i}") / F.nullif(F.col("rows"), F.lit(0))).alias("null_share"),
        )
        for i, f in enumerate(df.schema)
    ])
    return counts.select(F.inline(cells))


def describe(
    df: DataFrame, columns: list[str], by: list[str] | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum per column (and group)."""
    by = by or []
    keys = [quoted(b) for b in by]
    moments = written(sketched(df, columns, list(_QUARTILES), by, moments=True))
    quartiles = exact_quantiles(df, columns, list(_QUARTILES), by, block_rows, moments)
    wide = quartiles.groupBy(*keys, "column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for p, name in _QUARTILES.items()
    ])
    joined = null_safe_join(moments, wide, [*by, "column"], "left")
    return joined.select(*keys, "column", *[quoted(s) for s in STATS])


def describe_long(df: DataFrame, columns: list[str], by: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The same numbers transposed: one row per group, column and statistic."""
    by = by or []
    table = describe(df, columns, by, block_rows)
    cells = F.array(*[
        F.struct(F.lit(s).alias("stat"), quoted(s).cast("double").alias("value")) for s in STATS
    ])
    return table.select(*[quoted(b) for b in by], "column", F.inline(cells))


def variation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Coefficient of variation per column: sample deviation over mean."""
    row = df.agg(*[
        (F.stddev_samp(quoted(c)) / F.nullif(F.avg(quoted(c)), F.lit(0.0))).alias(f"v{i}") for i, c in enumerate(columns)
    ])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("cv")) for i, c in enumerate(columns)])
    return row.select(F.inline(cells))
