"""Pearson, Spearman and Kendall correlation matrices over pairwise-complete rows."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engagelake.operators.ordering import BLOCK_ROWS, block_offsets, find_blocks, single_value
from engagelake.schemas import numeric_columns, quoted
from engagelake.session import cut_lineage

SALTS = 64
#: Rows of a block that one Python task counts at a time, at least.
KENDALL_ROWS = 1 << 17


def correlation_matrix(
    df: DataFrame, columns: list[str] | None = None, method: str = "pearson", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Long matrix (column_a, column_b, r): both triangles and the unit diagonal."""
    columns = columns or numeric_columns(df)
    if len(columns) == 1:
        return _diagonal(df, columns)
    if method == "pearson":
        upper = _pearson(df, columns)
    elif method == "spearman":
        upper = _spearman(_pairs(df, columns, block_rows))
    elif method == "kendall":
        upper = _kendall(_pairs(df, columns, min(block_rows, kendall_rows(df.count()))))
    else:
        raise ValueError(f"unknown method {method!r}")
    return _mirror(upper, df, columns)


def _mirror(upper: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    both = F.explode(F.array(
        F.struct(F.col("a").alias("column_a"), F.col("b").alias("column_b")),
        F.struct(F.col("b").alias("column_a"), F.col("a").alias("column_b")),
    ))
    square = upper.select(both.alias("p"), "r").select("p.column_a", "p.column_b", "r")
    return square.union(_diagonal(df, columns))


def _diagonal(df: DataFrame, columns: list[str]) -> DataFrame:
    """1 for every column whose values differ, null for a constant or an empty one."""
    spread = df.agg(*[(F.min(quoted(c).cast("double")) < F.max(quoted(c).cast("double"))).alias(f"s{i}") for i, c in enumerate(columns)])
    return spread.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_a"), F.lit(c).alias("column_b"), F.when(F.col(f"s{i}"), 1.0).alias("r")) for i, c in enumerate(columns)
    ])))


def _pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs in one aggregation over the rows; a row with a null on either side is skipped."""
    pairs = list(combinations(columns, 2))
    def corr(a: str, b: str):
        # A constant column has no correlation; the built-in function divides by zero there.
        x, y = quoted(a).cast("double"), quoted(b).cast("double")
        x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))

    row = df.agg(*[corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)
    ])
    return row.select(F.inline(cells))


def _pairs(df: DataFrame, columns: list[str], block_rows: int) -> DataFrame:
    """Distinct value pairs with their weight ``c`` and value blocks, for every pair of columns at once.

    Several aggregations read them, so they are written once.
    """
    slim = df.select(*[quoted(c).cast("double").alias(c) for c in columns])
    names = {c: f"__b{i}" for i, c in enumerate(columns)}
    blocked = find_blocks(slim, columns, block_rows).apply(slim, names)
    cells = F.array(*[
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"), quoted(a).alias("x"), quoted(b).alias("y"),
            F.col(names[a]).alias("bx"), F.col(names[b]).alias("by"),
        )
        for a, b in combinations(columns, 2)
    ])
    complete = blocked.select(F.inline(cells)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return cut_lineage(complete.groupBy("a", "b", "x", "y", "bx", "by").agg(F.count(F.lit(1)).alias("c")))


def _average_rank(pairs: DataFrame, value: str, block: str, other: str, rank: str) -> DataFrame:
    """Average rank of ``value`` among the rows of its pair of columns.

    A single-value block takes its rank from the block totals, so its rows are spread over salts; only the
    blocks in between are ordered.
    """
    sizes = pairs.groupBy("a", "b", block).agg(F.sum("c").alias("n"))
    offsets = F.broadcast(block_offsets(sizes, ["a", "b"], block))  # two rows per cut and pair of columns
    single = single_value(F.col(block))
    salt = F.when(single, F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(F.lit(0))
    w = Window.partitionBy("a", "b", block, "__salt").orderBy(value)
    upto = F.sum("c").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("c").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = (
        pairs.withColumn("__salt", salt)
        .withColumns({"__upto": upto, "__ties": ties})
        .join(offsets, ["a", "b", block])
    )
    inner = F.col("before") + F.col("__upto") - F.col("__ties") + (F.col("__ties") + 1) / 2
    return ranked.withColumn(rank, F.when(single, F.col("before") + (F.col("n") + 1) / 2).otherwise(inner)).drop(
        "__salt", "__upto", "__ties", "before", "n"
    )


def _spearman(pairs: DataFrame) -> DataFrame:
    ranked = _average_rank(pairs, "x", "bx", "y", "rx")
    ranked = _average_rank(ranked, "y", "by", "x", "ry")
    sums = ranked.groupBy("a", "b").agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * F.col("rx")).alias("sx"),
        F.sum(F.col("c") * F.col("ry")).alias("sy"),
        F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("sxx"),
        F.sum(F.col("c") * F.col("ry") * F.col("ry")).alias("syy"),
        F.sum(F.col("c") * F.col("rx") * F.col("ry")).alias("sxy"),
    )
    covariance = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (
        F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    )
    return sums.select("a", "b", (covariance / F.nullif(F.sqrt(spread), F.lit(0.0))).alias("r"))


def weighted_dominance(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Sum of c_i*c_j over pairs with x_i < x_j and y_i < y_j, in n log n.

    Points stay sorted by x while they are split by the bits of the rank of y, highest first; two values of y
    part at exactly one bit, where the pair is counted through a running sum.
    """
    if len(x) < 2:
        return 0.0
    xr = np.unique(x, return_inverse=True)[1]
    yr = np.unique(y, return_inverse=True)[1]
    order = np.argsort(xr, kind="stable")
    xr, yr, c = xr[order], yr[order], np.asarray(c, dtype="float64")[order]
    at = np.arange(len(x))
    total = 0.0
    for bit in range(int(yr.max()).bit_length() - 1, -1, -1):
        prefix, upper = yr >> (bit + 1), (yr >> bit) & 1 == 1
        lower_weight = np.where(upper, 0.0, c)
        before = np.cumsum(lower_weight) - lower_weight
        new_prefix = np.append(True, prefix[1:] != prefix[:-1])
        new_run = new_prefix | np.append(True, xr[1:] != xr[:-1])
        run_start = np.maximum.accumulate(np.where(new_run, at, 0))
        prefix_start = np.maximum.accumulate(np.where(new_prefix, at, 0))
        below = before[run_start] - before[prefix_start]
        total += float(np.sum((c * below)[upper]))
        order = np.argsort(yr >> bit, kind="stable")
        xr, yr, c = xr[order], yr[order], c[order]
    return total


def kendall_rows(rows: int) -> int:
    """Rows of a block such that the totals of all pairs of blocks, about (2 rows / block)², are no more than a block."""
    return max(KENDALL_ROWS, math.ceil((2 * rows) ** (2 / 3)))


def _dominance_of_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    value = weighted_dominance(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy())
    return pd.DataFrame({"a": [key[0]], "b": [key[1]], "p": [value]})


def _dominance_points(pairs: DataFrame) -> DataFrame:
    """Concordant pairs split into three parts, each counted inside groups (a, b, part, block) of bounded size:

    pairs inside one x block; pairs across x blocks inside one y block; pairs across both, from block totals.
    A single-value block has no pair of the first two kinds and is left out, whatever its size.
    """

    def part(number: int, block: Column, u: str, v: str, keep: Column) -> Column:
        point = F.struct(
            F.lit(number).alias("part"), block.alias("block"), F.col(u).cast("double").alias("u"),
            F.col(v).cast("double").alias("v"),
        )
        return F.when(keep, point)

    parts = F.array_compact(F.array(
        part(0, F.col("bx"), "x", "y", ~single_value(F.col("bx"))),
        part(1, F.col("by"), "bx", "y", ~single_value(F.col("by"))),
        part(2, F.lit(0), "bx", "by", F.lit(True)),
    ))
    points = pairs.select("a", "b", "c", F.explode(parts).alias("p")).groupBy("a", "b", "p").agg(
        F.sum("c").cast("double").alias("w")
    )
    return points.select("a", "b", "p.part", "p.block", "p.u", "p.v", "w")


def _kendall(pairs: DataFrame) -> DataFrame:
    """Tau-b from the concordant pairs, the ties and all pairs."""
    concordant = (
        _dominance_points(pairs)
        .groupBy("a", "b", "part", "block")
        .applyInPandas(_dominance_of_group, "a string, b string, p double")
        .groupBy("a", "b")
        .agg(F.sum("p").alias("p"))
    )

    def ties(t: Column) -> Column:
        return F.sum(t.cast("double") * (t.cast("double") - 1) / 2)

    sides = F.explode(F.array(
        F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
        F.struct(F.lit("y").alias("side"), F.col("y").alias("value")),
    ))
    tied = (
        pairs.select("a", "b", "c", sides.alias("s")).groupBy("a", "b", "s").agg(F.sum("c").alias("t"))
        .groupBy("a", "b").agg(
            ties(F.when(F.col("s.side") == "x", F.col("t"))).alias("n_x"),
            ties(F.when(F.col("s.side") == "y", F.col("t"))).alias("n_y"),
        )
    )
    counts = pairs.groupBy("a", "b").agg(F.sum("c").cast("double").alias("rows"), ties(F.col("c")).alias("n_xy"))
    table = counts.join(tied, ["a", "b"]).join(concordant, ["a", "b"]).withColumn(
        "n", F.col("rows") * (F.col("rows") - 1) / 2
    )
    discordant = F.col("n") - F.col("n_x") - F.col("n_y") + F.col("n_xy") - F.col("p")
    scale = F.sqrt((F.col("n") - F.col("n_x")) * (F.col("n") - F.col("n_y")))
    return table.select("a", "b", ((F.col("p") - discordant) / F.nullif(scale, F.lit(0.0))).alias("r"))
