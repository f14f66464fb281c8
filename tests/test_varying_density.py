"""Clusters of varying density against a plain top-down construction, and the neighbour graph against brute force."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from engagelake.operators.topics import topics_by_stability, unit_vector
from engagelake.operators.varying_density import NOISE, neighbours, select, varying_density

FOLDER = "/root/testdata/sf0.1"


def blobs(seed, sizes=(40, 40, 60), dims=6, spreads=(0.05, 0.3, 1.0), noise=15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(len(sizes), dims)) * 6
    parts = [c + rng.normal(size=(n, dims)) * s for c, n, s in zip(centres, sizes, spreads, strict=True)]
    return np.concatenate([*parts, rng.uniform(-15, 15, size=(noise, dims))])


def plain_hdbscan(x, min_size, min_samples, k):
    """(label sets, noise, probability by row): the condensed tree built from the top down."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order = [sorted((d[i, j], j) for j in range(n) if j != i)[:k] for i in range(n)]
    core = [near[min_samples - 1][0] for near in order]
    edges = sorted({(max(v, core[i], core[j]), *sorted((i, j))) for i, near in enumerate(order) for v, j in near})
    part, nodes = {i: i for i in range(n)}, {i: (0.0, None, [i]) for i in range(n)}
    for w, i, j in edges:
        a, b = part[i], part[j]
        if a != b:
            new = len(nodes) + n
            nodes[new] = (w, (a, b), nodes[a][2] + nodes[b][2])
            for m in nodes[new][2]:
                part[m] = new
    tops = [t for t in set(part.values()) if len(nodes[t][2]) >= min_size]
    density = lambda h: 1 / max(h, 1e-9)
    clusters = []  # birth, falls {row: density}, parts

    def grow(node, birth):
        mine = {"birth": birth, "falls": {}, "parts": [], "stability": 0.0}
        clusters.append(mine)
        while True:
            w, sides, members = nodes[node]
            large = [s for s in sides or () if len(nodes[s][2]) >= min_size]
            if len(large) == 2:
                mine["stability"] += len(members) * (density(w) - birth)
                mine["parts"] = [grow(s, density(w)) for s in large]
                return mine
            gone = [m for s in sides if s not in large for m in nodes[s][2]]
            for m in gone:
                mine["falls"][m] = density(w)
                mine["stability"] += density(w) - birth
            if not large:
                return mine
            node = large[0]

    roots = [grow(t, 0.0) for t in tops]
    chosen = []

    def best(c, top):
        parts = [best(p, False) for p in c["parts"]]
        below = sum(v for v, _ in parts)
        if not (top and len(roots) == 1) and (not parts or c["stability"] >= below):
            return c["stability"], [c]
        return below, [x for _, some in parts for x in some]

    for r in roots:
        chosen += best(r, True)[1]

    def rows(c):
        out = dict(c["falls"])
        for p in c["parts"]:
            out |= rows(p)
        return out

    label, probability = {}, dict.fromkeys(range(n), 0.0)
    for number, c in enumerate(chosen):
        mine = rows(c)
        for m, value in mine.items():
            label[m], probability[m] = number, value / max(mine.values())
    return label, probability


@pytest.mark.parametrize("seed, chunk", [(1, 1 << 20), (2, 150)])
def test_clusters_equal_the_plain_construction(spark, seed, chunk):
    x = blobs(seed)
    rows = [(f"r{i:03d}", [float(v) for v in p]) for i, p in enumerate(x)]
    df = spark.createDataFrame([*rows, ("null", None), ("hole", [1.0, None])], "id string, v array<double>")
    got = {r["id"]: (r["cluster"], r["probability"]) for r in varying_density(df, "id", "v", 12, 4, 10, chunk=chunk).collect()}
    label, probability = plain_hdbscan(x, 12, 4, 10)
    assert set(got) == {k for k, _ in rows} and 2 <= len(set(label.values()))
    pairs = {(label.get(i, NOISE), got[f"r{i:03d}"][0]) for i in range(len(x))}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and ((NOISE, NOISE) in pairs) == (len(label) < len(x))
    assert [got[f"r{i:03d}"][1] for i in range(len(x))] == pytest.approx([probability[i] for i in range(len(x))])


def test_equal_vectors_and_little(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(30)] + [(100 + i, [9.0, float(i % 2)]) for i in range(30)], "id long, v array<double>")
    got = {r["id"]: r["cluster"] for r in varying_density(df, "id", "v", 10, 3, 5).collect()}
    assert len({got[i] for i in range(30)}) == 1 and got[0] != got[100] and NOISE not in got.values()
    alone = varying_density(df.where("id < 2"), "id", "v").collect()
    assert {r["cluster"] for r in alone} == {NOISE} and varying_density(df.where("id < 0"), "id", "v").count() == 0


def test_topics_by_stability(spark):
    rng = np.random.default_rng(5)
    centres = np.eye(8)[:3]
    rows = [(i, [float(v) for v in centres[i % 3] * 3 + rng.normal(size=8) * (0.02 + 0.1 * (i % 3))]) for i in range(90)]
    rows += [(900, [0.0] * 8), (901, None), (902, [float(v) for v in -np.ones(8)])]
    got = {r["k"]: (r["Topic"], r["Probability"]) for r in topics_by_stability(
        spark.createDataFrame(rows, "k long, embedding array<double>"), "k", min_size=10, min_samples=4, neighbours=8).collect()}
    assert len(got) == 93 and got[900] == got[901] == (-1, 0.0) and got[902][1] < 0.1
    inside = [[got[i][0] for i in range(j, 90, 3)] for j in range(3)]
    common = [max(set(some), key=some.count) for some in inside]
    assert sorted(common) == [0, 1, 2] and all(some.count(c) >= 25 for some, c in zip(inside, common, strict=True))


def test_the_length_of_a_vector_is_summed_once(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None])], "k long, e array<float>")
    made = df.select("k", unit_vector(F.col("e")).alias("u"))
    assert dict(map(tuple, made.collect())) == {1: [0.6, 0.8], 2: None, 3: None, 4: None}
    assert made._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1


def test_selection_prefers_the_more_stable():
    import pandas as pd

    rows = pd.DataFrame({"cluster": [1, 2, 3, 4, 5], "parent": [3, 3, 5, 5, None], "stability": [2.0, 3.0, 4.0, 9.0, 99.0]})
    assert dict(select(rows, True).to_numpy().tolist()) == {1: 1, 2: 2, 3: NOISE, 4: 4, 5: NOISE}
    assert dict(select(rows, False).to_numpy().tolist()) == dict.fromkeys(range(1, 6), 5)
    assert dict(select(rows.assign(stability=[2.0, 3.0, 5.0, 9.0, 1.0]), True).to_numpy().tolist()) == {1: 3, 2: 3, 3: 3, 4: 4, 5: NOISE}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_recall_of_the_neighbour_graph(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").selectExpr("vec_id AS id", "cast(embedding AS array<double>) AS x")
    table = rows.toPandas().sort_values("id")
    x = np.stack(table["x"].to_numpy())
    # A bound far below the rows, so that keys and passes come into play.
    got = {r["id"]: [e["other"] for e in r["near"]] for r in neighbours(rows, 15, block_rows=512).collect()}
    assert len(x) > 3 * 512
    hits = total = 0
    for low in range(0, len(x), 500):
        d = ((x[low:low + 500, None, :16] - x[None, :, :16]) ** 2).sum(2)
        for part in range(16, x.shape[1], 16):
            d += ((x[low:low + 500, None, part:part + 16] - x[None, :, part:part + 16]) ** 2).sum(2)
        d[np.arange(len(d)), np.arange(low, low + len(d))] = math.inf
        best = np.argsort(d, axis=1)[:, :15]
        for i, row in enumerate(best):
            hits += len(set(table["id"].to_numpy()[row]) & set(got[table["id"].iloc[low + i]]))
            total += 15
    print("recall", hits / total)
    assert hits / total >= 0.9
