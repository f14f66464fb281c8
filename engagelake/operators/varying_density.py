"""Clusters of varying density in any number of dimensions: neighbour graph, mutual reachability, condensed tree, stability.

1. The k nearest neighbours of every row are looked for in blocks of rows that are alike under random projections, in
   several passes; distances are exact, lists nearly so.
2. Two neighbours are as far apart as the largest of their distance and both core distances (to the neighbour number
   min_samples). Along these lengths components merge, and those of min_size rows and more form a tree.
3. Of each branch and its parts, the more stable is kept: the more rows stay together over the wider range of densities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.operators.linkage import CHUNK, SMALL, Forest
from engagelake.operators.ordering import dense_index
from engagelake.schemas import quoted
from engagelake.session import written

#: Rows of a block; passes over a table of two blocks, and their growth with each doubling of the rows.
BLOCK_ROWS, PASSES, GROWTH = 4096, 6, 1.35
#: Heights below this count as this (rows at one place), and clusters that one task may hold.
LEAST_HEIGHT, MOST_CLUSTERS = 1e-9, 2_000_000
NOISE = -1


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of each row among the others of a block, equal distances by id."""
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    k = min(k, len(ids) - 1)
    out, norms = [], (x * x).sum(1)
    for low in range(0, len(ids) if k > 0 else 0, 256):
        rough = norms[low:low + 256, None] + norms[None, :] - 2 * x[low:low + 256] @ x.T
        rough[np.arange(len(rough)), np.arange(low, low + len(rough))] = np.inf
        near = np.sort(np.argpartition(rough, min(k + 2, rough.shape[1] - 1), axis=1)[:, :k + 3], axis=1)
        exact = np.sqrt(((x[low:low + 256, None, :] - x[near]) ** 2).sum(2))
        exact[near == np.arange(low, low + len(rough))[:, None]] = np.inf
        best = np.argsort(exact, axis=1, kind="stable")[:, :k]
        rows = np.arange(len(rough))[:, None]
        out.append(pd.DataFrame({"id": np.repeat(ids[low:low + 256], k), "other": ids[near[rows, best]].ravel(), "d": exact[rows, best].ravel()}))
    return pd.concat(out) if out else pd.DataFrame({"id": [], "other": [], "d": []})


def passes_for(rows: int, fits: int = BLOCK_ROWS) -> tuple[int, int]:
    """(signs in a key, passes): keys of about ``fits`` rows, and more passes the more signs a pair must share."""
    signs = max(0, math.ceil(math.log2(max(rows, 1) / fits)))
    return signs, math.ceil(PASSES * GROWTH ** signs)


def neighbours(points: DataFrame, k: int, passes: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 42) -> DataFrame:
    """(id, near): for points (id long, x array<double>) up to k structs (d, other), nearest first.

    In every pass rows are sorted by the signs of some random projections, then by one more, and cut into blocks of
    about ``block_rows``; equal vectors are spread by their ids. A block is compared with itself. Up to ``block_rows``
    rows are one block, and answered exactly.
    """
    rows = points.count()
    signs, many = passes_for(rows, block_rows)
    blocks = math.ceil(rows / block_rows)
    many = 1 if rows <= block_rows else passes or many
    blocks = 1 if rows <= block_rows else blocks
    dims = points.select(F.max(F.size("x"))).first()[0] or 0
    found = None
    for turn in range(many):
        rng = np.random.default_rng([seed, turn])
        planes = rng.normal(size=(signs + 1, dims))

        def code(batches: Iterator[pd.DataFrame], planes=planes) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    z = np.stack(pdf["x"].to_numpy()) @ planes.T
                    key = ((z[:, :-1] > 0) * (1 << np.arange(z.shape[1] - 1))).sum(1)
                    yield pdf.assign(key=key.astype(np.int64), z=z[:, -1])

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield _nearest(pdf["id"].to_numpy(), np.stack(pdf["x"].to_numpy()), k)

        ranged = points.mapInPandas(code, "id long, x array<double>, key long, z double")
        ranged = ranged.repartitionByRange(blocks, "key", "z", F.xxhash64("id")).sortWithinPartitions("key", "z") if blocks > 1 else ranged.coalesce(1)
        some = ranged.select("id", "x").mapInPandas(look, "id long, other long, d double")
        found = some if found is None else found.union(some)
    # At most k entries per pass and row.
    lists = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "other"))), 1, k).alias("near"))
    return written(lists)


def reachability_edges(near: DataFrame, min_samples: int) -> DataFrame:
    """(x, y, w): neighbours with the largest of their distance and both core distances."""
    core = near.select("id", F.coalesce(F.get("near", F.lit(min_samples - 1))["d"], F.element_at("near", -1)["d"]).alias("core"))
    core = written(core)
    pairs = near.select("id", F.explode("near").alias("e")).select(
        F.least("id", "e.other").alias("x"), F.greatest("id", "e.other").alias("y"), F.col("e.d").alias("d")).distinct()
    for end in "xy":
        pairs = pairs.join(core.withColumnsRenamed({"id": end, "core": f"c{end}"}), end)
    return pairs.select("x", "y", F.greatest("d", "cx", "cy").alias("w"))


def stabilities(tree: DataFrame, points: DataFrame, tops: DataFrame) -> DataFrame:
    """(cluster, parent, stability): per cluster, over its rows, the density at which they leave less that at which it split off.

    Density is one over the height. The top of a component has no parent and exists from density 0 on.
    """
    dense = lambda h: 1 / F.greatest(F.col(h), F.lit(LEAST_HEIGHT))
    born = tree.select("cluster", "parent", dense("height").alias("birth")).union(
        tops.where(F.col("cluster") != SMALL).select("cluster", F.lit(None).cast("long"), F.lit(0.0)))
    left = points.select("cluster", dense("height").alias("at"), F.lit(1).cast("long").alias("n")).union(
        tree.select(F.col("parent"), dense("height"), F.col("size")))
    sums = left.groupBy("cluster").agg(F.sum(F.col("at") * F.col("n")).alias("at"), F.sum("n").alias("n"))
    return born.join(sums, "cluster").select("cluster", "parent", (F.col("at") - F.col("n") * F.col("birth")).alias("stability"))


def select(clusters: pd.DataFrame, one_top: bool) -> pd.DataFrame:
    """(cluster, chosen): the selected cluster that each cluster lies in, or NOISE. A single top is never selected itself.

    Children have smaller numbers than their parents, so one pass up sums what the parts are worth, and one pass down
    hands the choice on.
    """
    table = clusters.sort_values("cluster")
    ids = table["cluster"].tolist()
    parent = {c: (None if pd.isna(p) else int(p)) for c, p in zip(ids, table["parent"], strict=True)}
    own, parts = dict(zip(ids, table["stability"], strict=True)), dict.fromkeys(ids, 0.0)
    has_parts: set[int] = set()
    keep = {}
    for c in ids:
        bar = one_top and parent[c] is None
        keep[c] = not bar and (c not in has_parts or own[c] >= parts[c])
        if parent[c] is not None:
            parts[parent[c]] += own[c] if keep[c] else parts[c]
            has_parts.add(parent[c])
    chosen: dict[int, int] = {}
    for c in reversed(ids):
        above = chosen.get(parent[c], NOISE) if parent[c] is not None else NOISE
        chosen[c] = above if above != NOISE else (c if keep[c] else NOISE)
    return pd.DataFrame({"cluster": ids, "chosen": [chosen[c] for c in ids]})


def varying_density(
    df: DataFrame, key: str, vector: str, min_size: int = 15, min_samples: int = 5, k: int = 15, passes: int | None = None,
    chunk: int = CHUNK, seed: int = 42,
) -> DataFrame:
    """(key, cluster, probability): cluster −1 for noise; probability is the density of the row over the cluster's largest.

    Rows whose vector is null or holds a null are left out. Keys are unique. Where a table holds one component, its top
    is no cluster; components that share no neighbour are clusters of their own if nothing in them is more stable.
    """
    usable = quoted(vector).isNotNull() & ~F.exists(quoted(vector), lambda v: v.isNull() | F.isnan(v.cast("double")))
    points = df.where(usable).select(quoted(key).alias("key"), quoted(vector).cast("array<double>").alias("x"))
    numbered = written(dense_index(points, "key", "id"))
    near = neighbours(numbered.select("id", "x"), max(k, min_samples), passes, seed=seed)
    forest = Forest(numbered, chunk, min_size)
    forest.add(reachability_edges(near, min_samples))
    tree, fell = (written(t) for t in forest.condensed())
    worth = written(stabilities(tree, fell, forest.tops))
    count = worth.count()
    if count > MOST_CLUSTERS:
        raise ValueError(f"{count} clusters of {min_size} rows: raise min_size")
    one_top = worth.where("parent is null").count() == 1
    chosen = written(worth.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(
        lambda pdf: select(pdf, one_top), "cluster long, chosen long"))
    inside = fell.join(chosen, "cluster").where(F.col("chosen") != NOISE).select(
        "id", F.col("chosen").alias("cluster"), (1 / F.greatest("height", F.lit(LEAST_HEIGHT))).alias("density"))
    most = inside.groupBy("cluster").agg(F.max("density").alias("most"))
    scored = inside.join(most, "cluster").select("id", "cluster", (F.col("density") / F.col("most")).alias("probability"))
    out = numbered.select("id", "key").join(scored, "id", "left")
    return out.select(F.col("key").alias(key), F.coalesce("cluster", F.lit(NOISE)).cast("bigint").alias("cluster"), F.coalesce("probability", F.lit(0.0)).alias("probability"))
