"""Single linkage at all heights: the exact merge list of points on few dimensions, to be cut anywhere.

Edges come from a ladder of grids. When all edges up to a length are merged, components lie further apart than that, so a
cell of the next grid, RUNG times as wide, holds a bounded number of them, however many points they have; between two
components of neighbour cells only the nearest pair of points matters, and bounding boxes are halved until few can
hold it. Edges are merged in the order of (length, smaller id, larger id), CHUNK at a time, so no task holds more.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engagelake.operators.density import MAX_DIMENSIONS, _cell_key, _neighbour_offsets
from engagelake.operators.merging import cut
from engagelake.operators.ordering import dense_index
from engagelake.schemas import quoted
from engagelake.session import written

#: Points whose pairs one task may list, edges that one task merges, points of a cell of the first grid.
FEW, CHUNK, CROWD = 2048, 1 << 20, 64
#: Widening of the grid per rung, cuts of a box side per turn, turns of cutting.
RUNG, CUTS, TURNS = 4, 8, 6
OUT = "kind int, nr long, a long, b long, height double, size long"
MERGE, ROOT, CHILD, FALL = range(4)
SMALL = -1


def kruskal(
    sizes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, clusters: np.ndarray | None = None, min_size: int = 0,
    first: int = 0, stretch: int = 1 << 14,
) -> tuple[list[tuple], np.ndarray, list[tuple], list[tuple]]:
    """Merge along edges in order: ([(smaller root, larger root, length, size)], root of each node, children, falls).

    A set goes by its smallest node. With ``min_size``, ``clusters`` holds the cluster of each node that has that size
    (SMALL for others) and is kept up to date by root: sets become a cluster when they reach the size, named by the number
    of the merge (from ``first``); two clusters that merge are children (parent, child, length, size) of a new one; what
    is smaller falls into the cluster it meets: (node, cluster, length).
    """
    root, sizes, out = np.arange(len(sizes)), sizes.copy(), []
    children: list[tuple] = []
    falls: list[tuple] = []
    small = {i: [i] for i in np.flatnonzero(sizes < min_size).tolist()}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def condense(p: int, q: int, length: float) -> None:
        step, large = first + len(out), [sizes[i] >= min_size for i in (p, q)]
        if all(large):
            children.extend((step, int(clusters[i]), length, int(sizes[i])) for i in (p, q))
            clusters[p] = step
            return
        if any(large) or sizes[p] + sizes[q] >= min_size:
            clusters[p] = clusters[p] if large[0] else clusters[q] if large[1] else step
            for i in (p, q):
                falls.extend((k, int(clusters[p]), length) for k in small.pop(i, ()))
        else:
            small[p] += small.pop(q)

    for low in range(0, len(a), stretch):
        x, y = root[a[low:low + stretch]], root[b[low:low + stretch]]
        for k in np.flatnonzero(x != y).tolist():
            p, q = sorted((find(x[k]), find(y[k])))
            if p != q:
                if min_size:
                    condense(p, q, float(w[low + k]))
                root[q] = p
                sizes[p] += sizes[q]
                out.append((int(p), int(q), float(w[low + k]), int(sizes[p])))
        while (root[root] != root).any():
            root = root[root]
    return out, root, children, falls


def merge_edges(pdf: pd.DataFrame, made: int, min_size: int) -> pd.DataFrame:
    """Rows OUT from the edges (x, y, w) between components a and b of sizes na and nb in the clusters ca and cb.

    Columns are made as arrays: a tuple of Python numbers per row takes many times their space.
    """
    order = np.lexsort((pdf["y"], pdf["x"], pdf["w"]))
    ends = {c: pdf[c].to_numpy()[order] for c in ("a", "b", "na", "nb", "ca", "cb", "w")}
    n = len(pdf)
    del pdf
    labels, index = np.unique(np.concatenate([ends["a"], ends["b"]]), return_inverse=True)
    sizes, clusters = np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64)
    sizes[index] = np.concatenate([ends["na"], ends["nb"]])
    clusters[index] = np.concatenate([ends["ca"], ends["cb"]])
    length = ends["w"]
    del ends
    merges, root, children, falls = kruskal(sizes, index[:n], index[n:], length, clusters, min_size, made)
    whole = np.bincount(root, sizes, len(labels)).astype(np.int64)
    names = [c.split()[0] for c in OUT.split(", ")]

    def table(kind: int, *columns) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, (np.int32(kind), *columns), strict=True)), index=range(len(columns[1])))

    def taken(rows: list[tuple], *types) -> list[np.ndarray]:
        """The rows as columns; the rows go."""
        columns = [np.fromiter((r[i] for r in rows), t, len(rows)) for i, t in enumerate(types)]
        rows.clear()
        return columns

    p, q, h, size = taken(merges, np.int64, np.int64, float, np.int64)
    parts = [table(MERGE, made + np.arange(len(p)), labels[p], labels[q], h, size), table(ROOT, clusters[root], labels, labels[root], 0.0, whole[root])]
    parent, child, h, size = taken(children, np.int64, np.int64, float, np.int64)
    parts.append(table(CHILD, parent, child, 0, h, size))
    i, cluster, h = taken(falls, np.int64, np.int64, float)
    parts.append(table(FALL, cluster, labels[i], 0, h, 0))
    return pd.concat(parts, ignore_index=True)


class Forest:
    """Components that grow by edges, merges so far, and with ``min_size`` the condensed tree of clusters of that size.

    ``labels``: (id, label) of every node; ``tops``: (label, size, cluster) of every component.
    """

    def __init__(self, nodes: DataFrame, chunk: int = CHUNK, min_size: int = 0):
        self.chunk, self.min_size, self.made = chunk, min_size, 0
        self.batches: list[DataFrame] = []
        self.tree: list[DataFrame] = []
        self.points: list[DataFrame] = []
        self.labels = written(nodes.select(F.col("id"), F.col("id").alias("label")))
        self.tops = written(nodes.select(F.col("id").alias("label"), F.lit(1).cast("long").alias("size"), F.lit(SMALL).cast("long").alias("cluster")))

    def between(self, edges: DataFrame) -> DataFrame:
        """(x, y, w, a, b): the first edge (x, y, w) between every two components a < b."""
        for side, end in (("a", "x"), ("b", "y")):
            edges = edges.join(self.labels.withColumnsRenamed({"id": end, "label": side}), end)
        ends = edges.where("a <> b").select("x", "y", "w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        first = ends.groupBy("a", "b").agg(F.min(F.struct("w", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).alias("e"))
        return first.select("e.x", "e.y", "e.w", "a", "b")

    def add(self, edges: DataFrame) -> int:
        """Merge along edges (x, y, w) of node ids, none shorter than an edge added before; the merges made."""
        found = written(self.between(edges))
        total, before = found.count(), self.made
        parts = math.ceil(total / self.chunk)
        if parts > 1:
            order = found.repartitionByRange(parts, "w", "x", "y")
            found = written(order.withColumn("part", F.spark_partition_id()))
        for part in range(parts):
            some = found if parts == 1 else found.where(F.col("part") == part).select("x", "y", "w", "a", "b")
            self._merge(some if part == 0 else self.between(some.select("x", "y", "w")))
        return self.made - before

    def _merge(self, edges: DataFrame) -> None:
        made, min_size = self.made, self.min_size
        sized = edges
        for side in "ab":
            sized = sized.join(self.tops.withColumnsRenamed({"label": side, "size": f"n{side}", "cluster": f"c{side}"}), side)

        out = written(sized.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(lambda pdf: merge_edges(pdf, made, min_size), OUT))
        merges = out.where(F.col("kind") == MERGE).select(F.col("nr").alias("step"), "a", "b", "height", "size")
        self.made += merges.count()
        self.batches.append(merges)
        if min_size:
            self.tree.append(out.where(F.col("kind") == CHILD).select(F.col("nr").alias("parent"), F.col("a").alias("cluster"), "height", "size"))
            fell = out.where(F.col("kind") == FALL).select(F.col("a").alias("label"), F.col("nr").alias("cluster"), "height")
            self.points.append(self.labels.join(fell, "label").select("id", "cluster", "height"))
        moved = out.where(F.col("kind") == ROOT).select(
            F.col("a").alias("label"), F.col("b").alias("to"), F.col("size").alias("whole"), F.col("nr").alias("into"))
        self.labels = written(self.labels.join(moved.select("label", "to"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        rest = self.tops.join(moved, "label", "left_anti")
        self.tops = written(rest.union(moved.select(F.col("to").alias("label"), F.col("whole").alias("size"), F.col("into").alias("cluster")).distinct()))

    def _all(self, parts: list[DataFrame], schema: str) -> DataFrame:
        return reduce(DataFrame.union, parts, self.labels.sparkSession.createDataFrame([], schema))

    def merges(self) -> DataFrame:
        """(step, a, b, height, size): every merge of the components a < b, which goes by a from then on."""
        return self._all(self.batches, "step long, a long, b long, height double, size long")

    def condensed(self) -> tuple[DataFrame, DataFrame]:
        """(parent, cluster, height, size) of every cluster that merged with another; (id, cluster, height) of nodes that fell."""
        return (self._all(self.tree, "parent long, cluster long, height double, size long"),
                self._all(self.points, "id long, cluster long, height double"))


def _squares(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [p * p for p in parts])


def _gap(d: int) -> Column:
    """Squared distance of two boxes."""
    sides = [F.greatest(F.col(f"lo{i}_a") - F.col(f"hi{i}_b"), F.col(f"lo{i}_b") - F.col(f"hi{i}_a"), F.lit(0.0)) for i in range(d)]
    return _squares(sides)


def _span(d: int) -> Column:
    """Squared distance that no two points of two boxes exceed."""
    return _squares([F.greatest(F.col(f"hi{i}_a") - F.col(f"lo{i}_b"), F.col(f"hi{i}_b") - F.col(f"lo{i}_a")) for i in range(d)])


def _boxed(points: DataFrame, keys: list[str], d: int) -> DataFrame:
    limits = [f(f"x{i}").alias(f"{n}{i}") for i in range(d) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *limits)


def _sided(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{tag}") for c in df.columns])


def nearest_pairs(points: DataFrame, d: int, side: float, reach: float, rows: int) -> DataFrame:
    """(x, y, w): the nearest two points of every two components (``label``) that are within ``reach`` of each other."""
    grid = [f"g{i}" for i in range(d)]
    own = points.withColumns({f"g{i}": F.floor(F.col(f"x{i}") / side).cast("long") for i in range(d)})
    own = own.withColumn("cell", _cell_key([F.col(g) for g in grid])).withColumn("sub", F.lit(""))
    boxes = written(_boxed(own, ["cell", *grid, "label", "sub"], d))
    zero = (0,) * d
    forward = [o for o in _neighbour_offsets(d) if o > zero] + [zero]
    spread = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)], F.lit(o == zero).alias("here")) for o in forward]))
    a = _sided(boxes, "a").withColumn("o", spread)
    a = a.withColumn("to", _cell_key([F.col(f"g{i}_a") + F.col(f"o.o{i}") for i in range(d)]))
    pairs = a.join(_sided(boxes, "b"), F.col("to") == F.col("cell_b"))
    pairs = pairs.where("label_a <> label_b and (not o.here or label_a < label_b)").drop("o", "to", *[f"{g}_{t}" for g in grid for t in "ab"])
    keys = [f"{c}_{t}" for t in "ab" for c in ("cell", "label", "sub")]
    limit = reach * reach * (1 + 1e-9)
    for turn in range(TURNS):
        both = [F.least("label_a", "label_b").alias("p"), F.greatest("label_a", "label_b").alias("q")]
        judged = written(pairs.where(_gap(d) <= limit).select("*", *both, _gap(d).alias("gap"), _span(d).alias("span")))
        best = judged.groupBy("p", "q").agg((F.min("span") * (1 + 1e-9)).alias("best"))
        left = written(judged.join(best, ["p", "q"]).where("gap <= best").select(*keys, "n_a", "n_b"))
        work = left.agg(F.coalesce(F.sum(F.col("n_a").cast("double") * F.col("n_b")), F.lit(0.0))).first()[0]
        if work <= 16 * rows + 1e6 or turn == TURNS - 1:
            break
        # Cut the boxes that are left; what is far inside its component goes.
        step = side / CUTS ** (turn + 1)
        busy = left.select(*[F.col(f"{c}_a").alias(c) for c in ("cell", "label", "sub")]).union(
            left.select(*[F.col(f"{c}_b").alias(c) for c in ("cell", "label", "sub")])).distinct()
        own = own.join(busy, ["cell", "label", "sub"], "left_semi").withColumnRenamed("sub", "above")
        own = written(own.withColumn("sub", _cell_key([F.floor(F.col(f"x{i}") / step) for i in range(d)])))
        children = _boxed(own, ["cell", "label", "above", "sub"], d)
        pairs = left.drop("n_a", "n_b").withColumnsRenamed({"sub_a": "above_a", "sub_b": "above_b"})
        for tag in "ab":
            pairs = pairs.join(_sided(children, tag), [f"cell_{tag}", f"label_{tag}", f"above_{tag}"])
        pairs = pairs.drop("above_a", "above_b")
        own = own.drop("above")
    pairs = left.drop("n_a", "n_b")
    ends = own.select("cell", "label", "sub", "id", *[f"x{i}" for i in range(d)])
    for tag in "ab":
        pairs = pairs.join(_sided(ends, tag), [f"cell_{tag}", f"label_{tag}", f"sub_{tag}"])
    w = F.sqrt(_squares([F.col(f"x{i}_a") - F.col(f"x{i}_b") for i in range(d)]))
    near = pairs.select("label_a", "label_b", F.struct(
        w.alias("w"), F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y")).alias("e")).where(F.col("e.w") <= reach)
    return near.groupBy(F.least("label_a", "label_b"), F.greatest("label_a", "label_b")).agg(F.min("e").alias("e")).select("e.x", "e.y", "e.w")


def _all_pairs(points: DataFrame, d: int) -> DataFrame:
    """The merges of a few points, from all their pairs, in one task."""
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        x, ids, (i, j) = pdf[[f"x{k}" for k in range(d)]].to_numpy(), pdf["id"].to_numpy(), np.triu_indices(len(pdf), 1)
        total = np.zeros(len(i))
        for k in range(d):
            total += (x[i, k] - x[j, k]) * (x[i, k] - x[j, k])
        w = np.sqrt(total)
        order = np.argsort(w, kind="stable")
        merges, *_ = kruskal(np.ones(len(pdf), np.int64), i[order], j[order], w[order])
        rows = [(k, ids[p], ids[q], h, n) for k, (p, q, h, n) in enumerate(merges)]
        return pd.DataFrame(rows, columns=["step", "a", "b", "height", "size"])

    return points.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(work, "step long, a long, b long, height double, size long")


def _ladder(points: DataFrame, d: int, rows: int, chunk: int) -> DataFrame:
    axes = [f"x{i}" for i in range(d)]
    forest = Forest(points, chunk)
    same = points.groupBy(*axes).agg(F.min("id").alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = points.join(same, axes).where("id > x").select("x", F.col("id").alias("y"), F.lit(0.0).alias("w"))
    forest.add(copies)
    points = written(points.join(copies.select(F.col("y").alias("id")), "id", "left_anti"))
    limits = points.agg(*[F.max(a) - F.min(a) for a in axes], *[F.max(F.abs(a)) for a in axes]).first()
    extent, largest = max(limits[:d]), max(limits[d:])
    side = extent / max(rows ** (1 / d), 1.0) or 1.0
    # The first grid: no cell holds a crowd, or cells come close to the resolution of the numbers.
    while side > largest * 1e-13:
        cell = _cell_key([F.floor(F.col(a) / side).cast("long") for a in axes])
        if (points.groupBy(cell).count().agg(F.max("count")).first()[0] or 0) <= CROWD:
            break
        side /= RUNG
    while forest.tops.count() > 1:
        reach = side * math.sqrt(d) * (1 - 1e-9)
        here = points.join(forest.labels, "id")
        forest.add(nearest_pairs(here, d, side, reach, rows))
        side *= RUNG
    return forest.merges()


def merge_list(df: DataFrame, columns: list[str], key: str, few: int = FEW, chunk: int = CHUNK) -> DataFrame:
    """(step, a, b, height, size): all single-linkage merges of the rows, by height, then by the keys at the edge's ends.

    ``a`` and ``b`` name the components that merge by their smallest keys, ``size`` is what comes out, which goes by ``a``.
    Keys are unique and may be text; rows with a null in a column are left out. Points at one place merge at height 0.
    """
    d = len(columns)
    if not 1 <= d <= MAX_DIMENSIONS:
        raise ValueError(f"1 to {MAX_DIMENSIONS} columns: reduce the dimensions first")
    axes = [quoted(c).cast("double") for c in columns]
    present = reduce(lambda a, b: a & b, [a.isNotNull() for a in axes])
    points = df.where(present).select(quoted(key).alias("key"), *[a.alias(f"x{i}") for i, a in enumerate(axes)])
    numbered = written(dense_index(points, "key", "id"))
    rows = numbered.count()
    points = numbered.drop("key")
    merges = _all_pairs(points, d) if rows <= few else _ladder(points, d, rows, chunk)
    names = numbered.select("id", "key")
    for side in "ab":
        merges = merges.join(names.withColumnsRenamed({"id": side, "key": f"k{side}"}), side).drop(side).withColumnRenamed(f"k{side}", side)
    return merges.select("step", "a", "b", "height", "size")


def cut_at(merges: DataFrame, keys: DataFrame, height: float | None = None, clusters: int | None = None) -> DataFrame:
    """(topic, root): the component of every key (column ``topic``) after the merges up to ``height``, or down to ``clusters``."""
    if clusters is not None:
        made = max(keys.count() - clusters, 0)
        steps = merges
    else:
        steps, made = merges.where(F.col("height") <= height), 1 << 62
    named = steps.select(F.col("a").alias("topic_a"), F.col("b").alias("topic_b"), "step")
    return cut(named, keys, made)
