"""Order statistics without a global sort: value blocks, exact quantiles, average ranks.

A column is cut into value blocks at approximate quantiles. Every cut value gets a block of its own, so a value
that holds a large share of the rows never shares a block (and needs no sort inside it), while the blocks in
between hold about ``rows / parts`` rows each. Positions then come from block totals, a small table, plus an
order inside one block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engagelake.schemas import quoted
from engagelake.session import BROADCAST_ROWS, broadcast_if_small, cut_lineage, written

BLOCK_ROWS = 1_000_000


@dataclass(frozen=True)
class Blocks:
    """Cut values per column; no cuts means one block."""

    rows: int
    cuts: dict[str, list[float]]

    def apply(self, df: DataFrame, names: dict[str, str]) -> DataFrame:
        """Add one block number per column: 2i for cut value i, 2i+1 for the values above it."""
        cut = {c: n for c, n in names.items() if self.cuts[c]}
        out = df.withColumns({n: F.lit(1) for c, n in names.items() if c not in cut})
        if not cut:
            return out
        raw = {c: f"__raw_{n}" for c, n in cut.items()}
        interval = {c: f"__int_{n}" for c, n in cut.items()}
        out = out.withColumns({raw[c]: quoted(c).cast("double") for c in cut})
        splits = [[float("-inf"), *self.cuts[c], float("inf")] for c in cut]
        out = Bucketizer(
            splitsArray=splits,
            inputCols=list(raw.values()),
            outputCols=list(interval.values()),
            handleInvalid="keep",
        ).transform(out)
        blocks = {}
        for c, n in cut.items():
            lower = F.array(F.lit(float("-inf")), *[F.lit(v) for v in self.cuts[c]])
            number = F.col(interval[c]).cast("int")
            at_cut = F.col(raw[c]) == F.get(lower, number)
            blocks[n] = F.when(F.col(raw[c]).isNotNull(), 2 * number + F.when(at_cut, 0).otherwise(1))
        return out.withColumns(blocks).drop(*raw.values(), *interval.values())


def single_value(block: Column) -> Column:
    """True for the blocks that hold one cut value."""
    return block % 2 == 0


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal names where null meets null; the columns of the left side and the others of the right."""
    renamed = right.withColumnsRenamed({c: f"__r{i}" for i, c in enumerate(on)})
    match = [left[quoted_name(c)].eqNullSafe(renamed[f"__r{i}"]) for i, c in enumerate(on)]
    return left.join(renamed, reduce(lambda a, b: a & b, match), how).drop(*[f"__r{i}" for i in range(len(on))])


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def find_blocks(df: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS) -> Blocks:
    """Row count and the cut values of each column, so many that a block takes ``block_rows`` rows about.

    The driver sees one number per block and column.
    """
    rows = df.count()
    parts = math.ceil(rows / block_rows)
    if parts < 2:
        return Blocks(rows, {c: [] for c in columns})
    probs = ",".join(f"{k / parts:.9f}D" for k in range(1, parts))
    wide = df.select(*[quoted(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sketches = [f"percentile_approx(c{i}, array({probs}), {10 * parts}) AS c{i}" for i in range(len(columns))]
    row = wide.selectExpr(*sketches).first()
    cuts = {c: sorted({v for v in row[i] or [] if math.isfinite(v)}) for i, c in enumerate(columns)}
    return Blocks(rows, cuts)


def block_offsets(sizes: DataFrame, by: list[str], block: str, size: str = "n") -> DataFrame:
    """Rows before each block; at most two rows per cut and group enter a window."""
    w = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))


#: Accuracy of the quantile sketches: a rank is off by at most rows / SKETCH.
SKETCH = 10_000


#: A double that sorts like the value and compares everywhere: NaN, the largest value, counts as infinite.
ORDER = "if(isnan({0}), double('inf'), {0})"


def sketched(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str], moments: bool = False, accuracy: int = SKETCH
) -> DataFrame:
    """One scan: rows (by…, column, count, bounds) where ``bounds`` has a (prob, low, high) around every wanted quantile.

    The bounds are sketched three rank errors to either side, so the quantile lies between them; groups of fewer rows than
    the sketch can tell apart are taken whole. ``moments`` adds mean, std, min and max.
    """
    keys = [quoted(b) for b in by]
    margin = 3.0 / accuracy
    edges = ", ".join(f"{min(max(p + side, 0.0), 1.0)!r}D" for p in probs for side in (-margin, margin))
    table = df.select(*keys, *[quoted(c).cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    aggregates = []
    for i in range(len(columns)):
        x = f"__x{i}"
        aggregates += [f"count({x}) AS __n{i}", f"percentile_approx({ORDER.format(x)}, array({edges}), {accuracy}) AS __q{i}"]
        if moments:
            aggregates.append(f"struct(avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, max({x}) AS max) AS __m{i}")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__n{i}").alias("count"), F.col(f"__q{i}").alias("__q"),
                 *([F.col(f"__m{i}").alias("__m")] if moments else []))
        for i, c in enumerate(columns)
    ])
    long = table.groupBy(*keys).agg(*[F.expr(a) for a in aggregates]).select(*keys, F.inline(cells))
    bounds = ", ".join(
        f"struct({float(p)!r}D AS prob,"
        f" if(count <= {accuracy} OR {p <= margin}, double('-inf'), __q[{2 * k}]) AS low,"
        f" if(count <= {accuracy} OR {p >= 1 - margin}, double('inf'), __q[{2 * k + 1}]) AS high)"
        for k, p in enumerate(probs)
    )
    return long.select(*keys, "column", "count", F.expr(f"array({bounds}) AS bounds"), *(["__m.*"] if moments else []))


def _narrowed(seen: DataFrame, group: list[str], block_rows: int, parts: int = 100) -> DataFrame:
    """Keep, of the values that may hold a rank, the part that does, until no window takes more than ``block_rows`` values.

    Rows are (group…, rank, weight, x, c): c rows of value x, or c rows below all of these where x is null.
    """
    if seen.count() <= block_rows:  # from the footers of the stored table
        return seen
    keys = [quoted(g) for g in group]
    order = F.expr(ORDER.format("x"))
    points = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    while (seen.groupBy(*keys).agg(F.count("x").alias("n")).agg(F.max("n")).first()[0] or 0) > block_rows:
        cuts = seen.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(order, points, SKETCH)).alias("cuts"))
        part = F.when(F.col("x").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda cut: cut < order)))
        split = null_safe_join(seen, broadcast_if_small(cuts), group).withColumn("part", part).drop("cuts")
        sizes = split.groupBy(*keys, "weight", "part").agg(F.sum("c").alias("n"))
        placed = block_offsets(sizes, group, "part")
        holding = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
        chosen = broadcast_if_small(placed.where(holding).select(*keys, "weight", "part", "before"))
        values = null_safe_join(split, chosen.select(*keys, "part"), [*group, "part"], "left_semi").select(*seen.columns)
        lower = chosen.select(*keys, "weight", F.lit(None).cast("double").alias("x"), F.col("before").alias("c"))
        seen = written(values.unionByName(lower))
    return seen


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probs: list[float],
    by: list[str] | None = None,
    block_rows: int = BLOCK_ROWS,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, long form (by…, column, prob, value); nulls are skipped.

    Two scans at every size: sketches bound each quantile (``bounds``, if ``sketched`` has run and is stored already), then
    the rows below the bounds are counted and the few values between them, summed before the shuffle, are ordered. No window
    takes more than ``block_rows`` distinct values. A null group key is a group of its own; NaN is the largest value.
    """
    by = by or []
    keys = [quoted(b) for b in by]
    group = [*by, "column"]
    group_cols = [quoted(g) for g in group]
    if bounds is None:
        bounds = written(sketched(df, columns, probs, by))
    small = bounds.select(*group_cols, "count", "bounds")
    small = F.broadcast(small) if bounds.count() <= BROADCAST_ROWS else small
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("x")) for c in columns])
    long = df.select(*keys, F.inline(cells)).where("x is not null")
    order = ORDER.format("x")
    seen = (
        null_safe_join(long, small, group)
        .select(*group_cols, "count", "x", F.inline("bounds"))
        .where(f"{order} <= high")
        .withColumn("x", F.expr(f"if({order} >= low, x, null)"))
        .groupBy(*group_cols, "count", "prob", "x").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("at", F.expr("prob * (count - 1)"))
        .withColumn("rank", F.expr("explode(array_distinct(array(floor(at), ceil(at))))"))
        .select(*group_cols, "prob", "rank", F.expr("if(floor(at) = ceil(at), 1D, 1D - abs(at - rank)) AS weight"), "x", "c")
    )
    wanted = [*group, "prob", "rank"]
    seen = _narrowed(written(seen), wanted, block_rows)
    # The rows below, the null, come first.
    to_here = Window.partitionBy(*[quoted(w) for w in wanted]).orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
    hit = seen.withColumn("end", F.sum("c").over(to_here)).where("rank < end and rank >= end - c and x is not null")
    return hit.groupBy(*group_cols, "prob").agg(F.expr("sum(x * weight) AS value"))


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Number the rows 0, 1, 2, … in the order of a column of any ordered type, nulls first, without one global window.

    Rows are range partitioned by the column and stored; a partition's first number is the count of those before it.
    """
    ranged = cut_lineage(df.repartitionByRange(quoted(column)).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = block_offsets(sizes, [], "__part").select("__part", "before")  # one row per partition
    w = Window.partitionBy("__part").orderBy(quoted(column))
    return (
        ranged.withColumn("__row", F.row_number().over(w))
        .join(offsets, "__part")
        .withColumn(name, (F.col("before") + F.col("__row") - 1).cast("bigint"))
        .drop("__part", "__row", "before")
    )
