"""Density clustering on few dimensions, and single linkage as its special case.

Cells have the side eps/√d, so all points of one cell are within eps of each other. Hence:

* a cell with at least ``min_samples`` points holds core points only, without one distance computed;
* the other cells hold fewer than ``min_samples`` points each, so every point meets a bounded number of them,
  and the distances computed to decide core and border points grow linearly with the data;
* the core points of one cell belong to one cluster, so clusters are components over cells. Whether two
  neighbour cells touch is decided from bounding boxes, halved until the answer is certain.

A cell with a large share of all rows is cut into salted slices wherever its points are compared.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engagelake.operators.components import connected_components
from engagelake.operators.ordering import dense_index
from engagelake.schemas import quoted
from engagelake.session import cut_lineage

MAX_DIMENSIONS = 3
SLICE_ROWS = 20_000
MAX_LEVELS = 60
NOISE = -1


def _neighbour_offsets(d: int) -> list[tuple[int, ...]]:
    """Cells that can hold a point within eps of a cell, itself left out."""
    reach = math.ceil(math.sqrt(d))
    out = []
    for offset in product(range(-reach, reach + 1), repeat=d):
        gap = sum(max(abs(o) - 1, 0) ** 2 for o in offset)
        if any(offset) and gap <= d:
            out.append(offset)
    return out


def _cell_key(parts: list[Column]) -> Column:
    return F.concat_ws(",", *parts)


def _squared(names: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(f"{left}{n}") - F.col(f"{right}{n}")) ** 2 for n in names])


def _gridded(df: DataFrame, columns: list[str], key: str, eps: float) -> DataFrame:
    side = eps / math.sqrt(len(columns))
    axes = [quoted(c).cast("double") for c in columns]
    present = reduce(lambda a, b: a & b, [a.isNotNull() for a in axes])
    points = df.where(present).select(quoted(key).alias("key"), *[a.alias(f"x{i}") for i, a in enumerate(axes)])
    grid = {f"g{i}": F.floor(F.col(f"x{i}") / side) for i in range(len(columns))}
    return points.withColumns(grid).withColumn("cell", _cell_key([F.col(g) for g in grid]))


def _around(sparse: DataFrame, d: int, own: bool) -> DataFrame:
    """Points repeated for every cell around them, as (probe, p0…, cell)."""
    offsets = _neighbour_offsets(d) + ([tuple([0] * d)] if own else [])
    spread = F.explode(F.array(*[F.struct(*[F.lit(o).alias(f"o{i}") for i, o in enumerate(off)]) for off in offsets]))
    moved = sparse.withColumn("o", spread)
    cell = _cell_key([F.col(f"g{i}") + F.col(f"o.o{i}") for i in range(d)])
    return moved.select(F.col("key").alias("probe"), *[F.col(f"x{i}").alias(f"p{i}") for i in range(d)], cell.alias("cell"))


def _meet(probes: DataFrame, points: DataFrame, counts: DataFrame, d: int, eps: float) -> DataFrame:
    """Pairs (probe, point) within eps. Points of a large cell are spread over slices, probes go to each slice."""
    slices = counts.select("cell", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"))
    left = probes.join(slices, "cell").withColumn(
        "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    ).drop("slices")
    right = points.join(slices, "cell").withColumn(
        "slice", F.pmod(F.xxhash64("key"), F.col("slices")).cast("int")
    ).drop("slices")
    pairs = left.join(right, ["cell", "slice"])
    return pairs.where(_squared([str(i) for i in range(d)], "p", "x") <= eps * eps)


def core_points(df: DataFrame, columns: list[str], key: str, eps: float, min_samples: int) -> DataFrame:
    """(key, coordinates, cell, is_core); a point counts itself among its neighbours."""
    d = len(columns)
    if not 1 <= d <= MAX_DIMENSIONS:
        raise ValueError(f"1 to {MAX_DIMENSIONS} columns: reduce the dimensions first")
    points = _gridded(df, columns, key, eps)
    counts = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    marked = points.join(counts, "cell")
    sparse = marked.where(F.col("n") < min_samples)
    probes = _around(sparse, d, own=False)
    near = _meet(probes, points, counts, d, eps).groupBy("probe").agg(F.count(F.lit(1)).alias("near"))
    flagged = marked.join(near, marked["key"] == near["probe"], "left")
    own_and_near = F.col("n") + F.coalesce("near", F.lit(0))
    return flagged.withColumn("is_core", own_and_near >= min_samples).drop("probe", "near", "n")


def _boxes(points: DataFrame, group: list[str], d: int) -> DataFrame:
    limits = [f(f"x{i}").alias(f"{n}{i}") for i in range(d) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return points.groupBy(*group).agg(*limits)


def _side(boxes: DataFrame, d: int, tag: str) -> DataFrame:
    return boxes.select(*[F.col(c).alias(f"{c}_{tag}") for c in boxes.columns])


def _touching_cells(core: DataFrame, d: int, eps: float) -> DataFrame:
    """Edges (a, b) between neighbour cells with two core points within eps of each other."""
    side = eps / math.sqrt(d)
    grid = [f"g{i}" for i in range(d)]
    cells = _boxes(core, ["cell", *grid], d)
    forward = [o for o in _neighbour_offsets(d) if o > tuple([0] * d)]
    spread = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)]) for o in forward]))
    target = _cell_key([F.col(f"g{i}_a") + F.col(f"o.o{i}") for i in range(d)])
    a, b = _side(cells, d, "a"), _side(cells, d, "b")
    pairs = a.withColumn("o", spread).withColumn("cell_to", target)
    pairs = pairs.join(b, pairs["cell_to"] == b["cell_b"]).drop("o", "cell_to")

    # Distance limits between two boxes.
    gap = reduce(lambda x, y: x + y, [
        F.greatest(F.col(f"lo{i}_a") - F.col(f"hi{i}_b"), F.col(f"lo{i}_b") - F.col(f"hi{i}_a"), F.lit(0.0)) ** 2
        for i in range(d)
    ])
    span = reduce(lambda x, y: x + y, [
        F.greatest(F.col(f"hi{i}_a") - F.col(f"lo{i}_b"), F.col(f"hi{i}_b") - F.col(f"lo{i}_a")) ** 2 for i in range(d)
    ])
    verdict = F.when(span <= eps * eps, "touch").when(gap > eps * eps, "apart").otherwise("open")
    judged = cut_lineage(pairs.withColumn("verdict", verdict))
    edge = [F.col("cell_a").alias("a"), F.col("cell_b").alias("b")]
    edges = [judged.where("verdict = 'touch'").select(*edge)]
    undecided = judged.where("verdict = 'open'").select("cell_a", "cell_b")
    parents = None
    for level in range(1, MAX_LEVELS):
        if undecided.isEmpty():
            break
        # Halve the boxes of the cells that still have an open pair.
        step = side / 2**level
        busy = undecided.select(F.col("cell_a").alias("cell")).union(undecided.select("cell_b")).distinct()
        sub = _cell_key([F.floor(F.col(f"x{i}") / step) for i in range(d)])
        parent = _cell_key([F.floor(F.col(f"x{i}") / (2 * step)) for i in range(d)]) if level > 1 else F.col("cell")
        inner = core.join(busy, "cell", "left_semi").withColumns({"sub": sub, "parent": parent})
        boxes = _boxes(inner, ["cell", "parent", "sub"], d)
        open_pairs = undecided.select("cell_a", "cell_b", F.col("cell_a").alias("parent_a"), F.col("cell_b").alias("parent_b")) if parents is None else parents
        left, right = _side(boxes, d, "a"), _side(boxes, d, "b")
        children = open_pairs.join(left, ["cell_a", "parent_a"]).join(right, ["cell_b", "parent_b"])
        judged = cut_lineage(children.withColumn("verdict", verdict))
        touch = judged.where("verdict = 'touch'").select("cell_a", "cell_b").distinct()
        edges.append(touch.select(*edge))
        still = judged.where("verdict = 'open'").join(touch, ["cell_a", "cell_b"], "left_anti")
        parents = still.select("cell_a", "cell_b", F.col("sub_a").alias("parent_a"), F.col("sub_b").alias("parent_b"))
        undecided = still.select("cell_a", "cell_b").distinct()
    else:
        raise RuntimeError("bounding boxes did not separate")
    return reduce(DataFrame.union, edges).distinct()


def dbscan(df: DataFrame, columns: list[str], key: str, eps: float, min_samples: int) -> DataFrame:
    """(key, is_core, cluster): clusters numbered by their smallest core key (numeric), noise −1.

    A border point goes to the cluster with the smallest number within reach.
    """
    d = len(columns)
    points = cut_lineage(core_points(df, columns, key, eps, min_samples))
    core = points.where("is_core")
    cells = core.groupBy("cell").agg(F.min("key").alias("smallest"))
    component = connected_components(cells.select(F.col("cell").alias("node")), _touching_cells(core, d, eps))
    grouped = cells.join(component, cells["cell"] == component["node"])
    first = grouped.groupBy("component").agg(F.min("smallest").alias("smallest"))
    numbered = dense_index(first, "smallest", "cluster")
    cell_cluster = cut_lineage(grouped.select("cell", "component").join(numbered, "component").select("cell", "cluster"))
    labelled_core = core.join(cell_cluster, "cell")
    counts = core.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    border = points.where(~F.col("is_core"))
    reached = (
        _meet(_around(border, d, own=True), labelled_core, counts, d, eps)
        .groupBy("probe").agg(F.min("cluster").alias("cluster"))
    )
    outer = border.join(reached, border["key"] == reached["probe"], "left")
    parts = labelled_core.select("key", "is_core", "cluster").union(
        outer.select("key", "is_core", F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
    )
    return parts.select(F.col("key").alias(key), "is_core", F.col("cluster").cast("bigint").alias("cluster"))


def single_linkage(df: DataFrame, columns: list[str], key: str, distance: float) -> DataFrame:
    """Single-linkage clusters cut at a distance: density clusters in which every point is a core point."""
    return dbscan(df, columns, key, distance, min_samples=1)
