"""Single linkage at all heights against brute force."""

import itertools
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from engagelake.operators import linkage
from engagelake.operators.density import single_linkage
from engagelake.operators.linkage import cut_at, merge_list


def brute_list(points):
    """Kruskal over all pairs by (distance, keys)."""
    root, size, out = {k: k for k in points}, dict.fromkeys(points, 1), []
    def length(a, b):
        total = 0.0
        for p, q in zip(points[a], points[b], strict=True):  # the sum of a list would be compensated
            total += (p - q) * (p - q)
        return math.sqrt(total)

    pairs = sorted((length(a, b), a, b) for a, b in itertools.combinations(sorted(points), 2))
    for w, a, b in pairs:
        p, q = sorted((root[a], root[b]))
        if p != q:
            root = {k: p if r == q else r for k, r in root.items()}
            size[p] += size[q]
            out.append((len(out), p, q, w, size[p]))
    return out


def cloud(kind, n, d, seed):
    rng = random.Random(seed)
    if kind == "ties":  # a small grid, with many points at one place
        return [tuple(float(rng.randrange(6)) for _ in range(d)) for _ in range(n)]
    if kind == "scales":  # dense knots, a wide haze and a far point
        out = [tuple(rng.gauss(0, 1e-6) + rng.randrange(2) * 10 for _ in range(d)) for _ in range(n // 2)]
        return out + [tuple(rng.uniform(-50, 50) for _ in range(d)) for _ in range(n - n // 2 - 1)] + [(1e6,) * d]
    return [tuple(rng.gauss(0, 1) for _ in range(d)) for _ in range(n)]


@pytest.mark.parametrize("kind, n, d, few, chunk", [
    ("ties", 120, 2, 2048, 1 << 20), ("ties", 60, 2, 1, 40), ("scales", 80, 2, 1, 1 << 20), ("plain", 60, 3, 1, 1 << 20), ("plain", 50, 1, 2048, 9)])
def test_merge_list_equals_brute_force(spark, kind, n, d, few, chunk):
    points = {f"k{i:03d}": p for i, p in enumerate(cloud(kind, n, d, n + d))}
    columns = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(k, *p) for k, p in points.items()] + [("null", *[None] * d)], f"id string, {', '.join(f'{c} double' for c in columns)}")
    got = [tuple(r) for r in merge_list(df, columns, "id", few, chunk).orderBy("step").collect()]
    assert got == brute_list(points)


def test_cuts_are_single_linkage_clusters(spark):
    points = {i: p for i, p in enumerate(cloud("plain", 70, 2, 3))}
    df = spark.createDataFrame([(k, *p) for k, p in points.items()], "id long, u double, v double")
    merges = merge_list(df, ["u", "v"], "id")
    keys = df.selectExpr("id AS topic")
    got = {r["topic"]: r["root"] for r in cut_at(merges, keys, height=0.4).collect()}
    clusters = {r["id"]: r["cluster"] for r in single_linkage(df, ["u", "v"], "id", 0.4).collect()}
    assert sorted(set(got.values())) == [min(k for k, c in clusters.items() if c == x) for x in sorted(set(clusters.values()))]
    assert all((got[a] == got[b]) == (clusters[a] == clusters[b]) for a, b in itertools.combinations(points, 2))
    assert len({r["root"] for r in cut_at(merges, keys, clusters=5).collect()}) == 5


def test_merge_list_of_little(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, u double")
    assert merge_list(df, ["u"], "id").count() == 0 and merge_list(df, ["u"], "id", few=0).count() == 0
    assert merge_list(df.where("id > 1"), ["u"], "id").count() == 0
    with pytest.raises(ValueError, match="columns"):
        merge_list(df, ["u"] * 4, "id")


def test_merging_takes_little_beside_the_edges():
    """A chain of 60,000 edges: some 100 bytes an edge and column of the result, no row objects that stay."""
    n = 60_000
    edges = pd.DataFrame({"x": np.arange(n), "y": np.arange(1, n + 1), "w": np.arange(n) / n, "a": np.arange(n), "b": np.arange(1, n + 1)})
    tracemalloc.start()
    out = linkage.merge_edges(edges.assign(na=1, nb=1, ca=-1, cb=-1), 0, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 2 * n + 1 and out["size"].max() == n + 1 and (out["b"][out["kind"] == linkage.ROOT] == 0).all()
    assert peak < 600 * n
