"""Counts, pivots, shares and top rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engagelake.functions.casts import round_even
from engagelake.functions.dates import weekday_index, weekday_name
from engagelake.functions.text import merge_missing_prefix
from engagelake.operators.ordering import null_safe_join
from engagelake.schemas import quoted
from engagelake.session import broadcast_if_small


def group_sizes(df: DataFrame, keys: list[str], drop_null_keys: bool = True) -> DataFrame:
    """Rows per key combination."""
    if drop_null_keys:
        df = df.where(reduce(lambda a, b: a & b, [quoted(k).isNotNull() for k in keys]))
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))


def value_counts(df: DataFrame, column: str, merge_missing: bool = False) -> DataFrame:
    """Rows per value, most frequent first, nulls left out."""
    value = quoted(column)
    if merge_missing:
        value = merge_missing_prefix(value)
    return (
        df.where(quoted(column).isNotNull())
        .groupBy(value.alias(column))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), quoted(column))
    )


def pivot_sizes(df: DataFrame, row: str, column: str, values: list, fill: int | None = None) -> DataFrame:
    """Rows per (row, column) as a wide table; the column values are named, so no pass looks for them."""
    table = df.where(quoted(row).isNotNull()).groupBy(quoted(row)).pivot(column, values).agg(F.count(F.lit(1)))
    return table if fill is None else table.na.fill(fill, [str(v) for v in values])


def shares(sizes: DataFrame, count: str = "count", digits: int = 1) -> DataFrame:
    """Percent of the total per row of a counted table; the total is a scalar subquery, not a global window."""
    total = sizes.agg(F.sum(quoted(count))).scalar()
    return sizes.withColumn("share", round_even(100.0 * quoted(count) / total, digits))


def weekday_table(df: DataFrame, when: str, kind: str, kinds: list[str], fill: int | None = None) -> DataFrame:
    """Publications per weekday and content type, Monday first."""
    day = df.where(quoted(when).isNotNull()).withColumns(
        {"weekday": weekday_index(quoted(when)), "dia": weekday_name(quoted(when))}
    )
    table = day.groupBy("weekday", "dia").pivot(kind, kinds).agg(F.count(F.lit(1)))
    if fill is not None:
        table = table.na.fill(fill, kinds)
    return table.orderBy("weekday")


def top_n(df: DataFrame, metric: str, key: str, n: int = 5, ascending: bool = False) -> DataFrame:
    """The first n rows by a metric; nulls last, ties by key."""
    by = quoted(metric).asc_nulls_last() if ascending else quoted(metric).desc_nulls_last()
    return df.orderBy(by, quoted(key)).limit(n)


def latest_per_owner(df: DataFrame, n: int, owner: str = "ownerId", when: str = "data_hora", key: str = "id") -> DataFrame:
    """At most n newest rows per owner; Spark limits each partition before the shuffle."""
    w = Window.partitionBy(quoted(owner)).orderBy(quoted(when).desc_nulls_last(), quoted(key))
    return df.withColumn("__row", F.row_number().over(w)).where(F.col("__row") <= n).drop("__row")


def sample_per_group(df: DataFrame, group: str, key: str, n: int = 10, seed: int = 42) -> DataFrame:
    """A repeatable random sample of at most n rows per group."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), quoted(key).cast("string")))
    w = Window.partitionBy(quoted(group)).orderBy(draw, quoted(key))
    return df.withColumn("__row", F.row_number().over(w)).where(F.col("__row") <= n).drop("__row")


def collect_per_group(df: DataFrame, group: str, value: str, key: str, chunk: int = 1000) -> DataFrame:
    """All values of a group as lists of about ``chunk`` values: (group, part, values).

    A large group becomes many rows, so no task holds a whole group: the sizes go to the rows, not the rows to their group.
    Null values stay, and a null group is a group.
    """
    slim = df.select(quoted(group), quoted(key).alias("__key"), quoted(value).alias("__value"))
    sizes = broadcast_if_small(slim.groupBy(quoted(group)).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("__parts")))
    return (
        null_safe_join(slim, sizes, [group])
        .withColumn("part", F.pmod(F.xxhash64("__key"), F.col("__parts")).cast("int"))
        .groupBy(quoted(group), "part")
        .agg(F.collect_list(F.struct("__value")).alias("values"))
        .withColumn("values", F.transform("values", lambda v: v["__value"]))  # a list of bare values leaves nulls out
    )
