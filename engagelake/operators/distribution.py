"""Outliers, box plots, histograms, normality and serial correlation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engagelake.operators.ordering import BLOCK_ROWS, exact_quantiles, find_blocks, null_safe_join, single_value
from engagelake.schemas import quoted
from engagelake.session import broadcast_if_small


def _moments(df: DataFrame, columns: list[str]) -> Column:
    """Mean and population deviation of every column as one scalar subquery."""
    fields = []
    for i, c in enumerate(columns):
        x = quoted(c).cast("double")
        fields += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}")]
    return df.agg(F.struct(*fields).alias("moments")).scalar()


def standardize(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """Population z-scores; a constant column gives 0."""
    moments = _moments(df, columns)
    scores = {}
    for i, c in enumerate(columns):
        centred = quoted(c).cast("double") - moments.getField(f"m{i}")
        scale = moments.getField(f"s{i}")
        scores[c + suffix] = F.when(scale == 0, centred * 0.0).otherwise(centred / F.nullif(scale, F.lit(0.0)))
    return df.withColumns(scores)


def zscore_filter(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Rows whose population z-score is inside the limit in every column; a null drops the row."""
    moments = _moments(df, columns)
    checks = [
        F.abs(quoted(c).cast("double") - moments.getField(f"m{i}")) < F.lit(limit) * moments.getField(f"s{i}")
        for i, c in enumerate(columns)
    ]
    return df.where(reduce(lambda a, b: a & b, checks))


def boxplot(
    df: DataFrame, columns: list[str], by: list[str] | None = None, whisker: float = 1.5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Quartiles, whiskers inside ``whisker`` interquartile ranges, and the number of outliers."""
    by = by or []
    keys = [quoted(b) for b in by]
    group = [*by, "column"]
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], by, block_rows)
    box = q.groupBy(*keys, "column").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n)
        for p, n in [(0.25, "q1"), (0.5, "median"), (0.75, "q3")]
    ])
    reach = F.lit(whisker) * (F.col("q3") - F.col("q1"))
    box = box.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("x")) for c in columns])
    values = df.select(*keys, F.inline(cells)).where(F.col("x").isNotNull())
    inside = F.col("x").between(F.col("low"), F.col("high"))
    return (
        null_safe_join(values, broadcast_if_small(box), group)
        .groupBy(*keys, "column")
        .agg(
            F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over the value range, the last one closed on the right; empty bins count 0."""
    x = quoted(column).cast("double")
    limits = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("limits")).scalar()
    lo, hi = limits.getField("lo"), limits.getField("hi")
    width = F.nullif(hi - lo, F.lit(0.0)) / bins
    number = F.coalesce(F.least(F.floor((x - lo) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    step = (hi - lo) / bins
    return frame.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * step).alias("from"),
        (lo + (F.col("bin") + 1) * step).alias("to"),
        F.coalesce("n", F.lit(0)).alias("count"),
    )


def jarque_bera(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Normality from skewness and excess kurtosis in one pass; p is exact for the chi-square with 2 degrees."""
    x = quoted(column).cast("double")
    moments = df.agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
    jb = F.col("n") / 6.0 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4.0)
    return moments.withColumn("jb", jb).withColumns(
        {"p_value": F.exp(-F.col("jb") / 2), "normal": F.exp(-F.col("jb") / 2) > alpha}
    )


def kolmogorov_smirnov(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Distance to the normal law with the column's own mean and deviation.

    The p-value is that of a law fixed beforehand, so it is too large here: ``normal`` says yes too often.
    """
    from pyspark.ml.stat import KolmogorovSmirnovTest

    x = quoted(column).cast("double")
    values = df.where(x.isNotNull()).select(x.alias("x"))
    mean, deviation = values.agg(F.avg("x"), F.stddev_samp("x")).first()
    result = KolmogorovSmirnovTest.test(values, "x", "norm", float(mean), float(deviation))
    return result.select(
        F.col("statistic"), F.col("pValue").alias("p_value"), (F.col("pValue") > alpha).alias("normal")
    )


def durbin_watson(
    df: DataFrame, residual: str, order: str, ties: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Sum of squared steps over sum of squares, along a numeric order column with tie columns behind it.

    Steps inside a value block come from a window over that block; the step from block to block from the last
    and first residual of each. A block of one hot order value is cut again by the first tie column (numeric).
    """
    e = quoted(residual).cast("double")
    tie_names = [f"t{i}" for i in range(len(ties))]
    slim = df.where(e.isNotNull()).select(
        e.alias("e"), quoted(order).cast("double").alias("o"),
        *[quoted(t).alias(n) for t, n in zip(ties, tie_names)],
    )
    blocks = find_blocks(slim, ["o", tie_names[0]], block_rows)
    blocked = blocks.apply(slim, {"o": "b1", tie_names[0]: "b2"})
    blocked = blocked.withColumn("b2", F.when(single_value(F.col("b1")), F.col("b2")).otherwise(F.lit(1)))
    w = Window.partitionBy("b1", "b2").orderBy("o", *tie_names)
    place = F.struct("o", *tie_names)
    per_block = (
        blocked.withColumn("step", F.col("e") - F.lag("e").over(w))
        .groupBy("b1", "b2")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.col("step") ** 2), F.lit(0.0)).alias("steps"),
            F.sum(F.col("e") ** 2).alias("squares"),
            F.min_by("e", place).alias("first"),
            F.max_by("e", place).alias("last"),
        )
    )
    # One row per block; a block of one hot order value has one per block of the first tie column.
    seam = F.col("first") - F.lag("last").over(Window.orderBy("b1", "b2"))
    total = per_block.withColumn("seam", F.coalesce(seam, F.lit(0.0))).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("steps") + F.col("seam") ** 2) / F.nullif(F.sum("squares"), F.lit(0.0))).alias("durbin_watson"),
    )
    free = (F.col("durbin_watson") > 1.5) & (F.col("durbin_watson") < 2.5)
    return total.withColumn("uncorrelated", free)


def two_series(df: DataFrame, label: str, bar: str, line: str) -> DataFrame:
    """The metric pair behind a bar and line chart, largest bar first, nulls last."""
    return df.select(quoted(label), quoted(bar), quoted(line)).orderBy(quoted(bar).desc_nulls_last(), quoted(label))
