import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engagelake.operators import clustering, density
from engagelake.operators.clustering import (
    _distances,
    _pair_blocks,
    auto_cluster,
    bisecting_kmeans,
    centre_indices,
    cluster_limit,
    combine_scores,
    kmeans,
    silhouette_estimate,
    silhouette_samples,
    silhouette_squared,
    validity,
)
from engagelake.operators.components import connected_components, principal_components
from engagelake.operators.density import core_points, dbscan, single_linkage
from engagelake.operators.distribution import standardize
from engagelake.session import written

RNG = np.random.default_rng(1)


def frame(spark, points, **more):
    made = pd.DataFrame(points, columns=[f"c{i}" for i in range(points.shape[1])])
    return spark.createDataFrame(made.assign(k=np.arange(len(points)), **more))


def brute_dbscan(points, eps, min_samples):
    near = ((points[:, None] - points[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= min_samples
    label, number = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        stack, label[i] = [i], number
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                label[j] = number
                stack.append(j)
        number += 1
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        label[i] = reached.min() if len(reached) else -1
    return core, label


@pytest.mark.parametrize("d, eps, min_samples", [(1, 0.02, 4), (2, 0.3, 5), (3, 0.4, 6)])
def test_density_clusters_against_brute_force(spark, monkeypatch, d, eps, min_samples):
    monkeypatch.setattr(density, "SLICE_ROWS", 50)  # the hot cell is cut into slices
    blobs = [RNG.normal(size=(150, d)), RNG.normal(size=(200, d)) * 0.05 + 1.5, RNG.normal(size=(100, d)) * 0.03 + 1.8,
             RNG.uniform(-3, 3, size=(50, d))]
    points = np.concatenate([*blobs, blobs[0][:30], np.full((60, d), 2.5)])  # copies and one hot spot
    core, label = brute_dbscan(points, eps, min_samples)
    got = dbscan(frame(spark, points), [f"c{i}" for i in range(d)], "k", eps, min_samples).toPandas().sort_values("k")
    assert (got["is_core"].to_numpy() == core).all() and (got["cluster"].to_numpy() == label).all()


def test_single_linkage_is_components_at_a_distance(spark):
    points = RNG.uniform(0, 10, size=(200, 2))
    _, label = brute_dbscan(points, 0.8, 1)
    got = single_linkage(frame(spark, points), ["c0", "c1"], "k", 0.8).toPandas().sort_values("k")
    assert (got["cluster"].to_numpy() == label).all()


def test_density_needs_few_dimensions(spark):
    with pytest.raises(ValueError):
        core_points(frame(spark, np.zeros((2, 4))), ["c0", "c1", "c2", "c3"], "k", 1.0, 2)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(40)] + [(7, 7)]
    nodes = spark.range(0, 200).withColumnRenamed("id", "node")
    table = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, table).collect()}
    assert len(got) == 200 and {got[i] for i in range(61)} == {0}
    assert {got[i] for i in range(100, 141)} == {100} and got[150] == 150


def test_principal_components(spark):
    x = RNG.normal(size=(300, 4)) @ RNG.normal(size=(4, 4))
    scores, variance, loadings = principal_components(frame(spark, x), ["c0", "c1", "c2", "c3"], 2)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    order = np.argsort(values)[::-1]
    assert [r["explained"] for r in variance.collect()] == pytest.approx(list(values[order][:2] / values.sum()))
    assert variance.collect()[1]["cumulative"] == pytest.approx(values[order][:2].sum() / values.sum())
    table = loadings.toPandas().set_index("variable")[["PC1", "PC2"]].to_numpy()
    assert np.abs(table) == pytest.approx(np.abs(vectors[:, order[:2]]))
    assert all(table[np.abs(table[:, j]).argmax(), j] > 0 for j in range(2))
    got = scores.orderBy("k").toPandas()[["PC1", "PC2"]].to_numpy()
    assert got == pytest.approx(z @ table)


@pytest.fixture(scope="module")
def blobs(spark):
    points = np.concatenate([RNG.normal(size=(40, 2)) * 0.2 + c for c in ([0, 0], [4, 0], [0, 4])])
    return points, frame(spark, points, cluster=np.repeat([0, 1, 2], 40)).cache()


def test_validity_against_brute_force(blobs):
    points, df = blobs
    label = np.repeat([0, 1, 2], 40)
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    s = []
    for i in range(len(points)):
        mean = [apart[i, label == c].sum() / ((label == c).sum() - (c == label[i])) for c in range(3)]
        b = min(m for c, m in enumerate(mean) if c != label[i])
        s.append((b - mean[label[i]]) / max(b, mean[label[i]]))
    centre = np.array([points[label == c].mean(0) for c in range(3)])
    within = sum(((points[label == c] - centre[c]) ** 2).sum() for c in range(3))
    between = sum(40 * ((centre[c] - points.mean(0)) ** 2).sum() for c in range(3))
    radius = [np.sqrt(((points[label == c] - centre[c]) ** 2).sum(1)).mean() for c in range(3)]
    db = np.mean([max((radius[i] + radius[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(3) if j != i) for i in range(3)])
    got = validity(df, ["c0", "c1"], "k")
    assert got["silhouette"] == pytest.approx(np.mean(s))
    assert got["calinski_harabasz"] == pytest.approx((between / 2) / (within / (len(points) - 3)))
    assert got["davies_bouldin"] == pytest.approx(db)
    assert got["score"] == pytest.approx(combine_scores(np.mean(s), got["calinski_harabasz"], db))
    blocked = silhouette_samples(df, ["c0", "c1"], "k", block_rows=17).orderBy("k").toPandas()
    assert blocked["silhouette"].to_numpy() == pytest.approx(np.array(s))
    assert silhouette_squared(df, ["c0", "c1"]) > got["silhouette"]


def test_silhouette_of_many_columns(spark):
    """Two blocks meet once, through a matrix product; equal and nearly equal rows far from the origin keep their digits."""
    points = np.concatenate([RNG.normal(size=(60, 12)) + 1e4 * (i % 2) for i in range(3)])
    points[1], points[2] = points[0], points[0] + 1e-7
    label = np.arange(len(points)) % 3
    columns = [f"c{i}" for i in range(12)]
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    assert _distances(points, points) == pytest.approx(apart, rel=1e-9, abs=0)
    mean = np.stack([apart[:, label == c].sum(1) / np.where(label == c, (label == c).sum() - 1, (label == c).sum()) for c in range(3)], axis=1)
    a = mean[np.arange(len(points)), label]
    mean[np.arange(len(points)), label] = np.inf
    want = (mean.min(1) - a) / np.maximum(mean.min(1), a)
    got = silhouette_samples(frame(spark, points, cluster=label), columns, "k", block_rows=50).orderBy("k").toPandas()
    assert got["silhouette"].to_numpy() == pytest.approx(want, abs=1e-9)
    # A row at infinity is far from all others, and changes no other row's nearest cluster.
    far = np.concatenate([points, np.full((1, 12), np.inf)])
    got = silhouette_samples(frame(spark, far, cluster=np.append(label, 7)), columns, "k", block_rows=50).orderBy("k").toPandas()
    assert got["silhouette"].to_numpy()[:-1] == pytest.approx(want, abs=1e-9)


def test_block_pairs_meet_once(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    met = _pair_blocks(df, "k", 1000, lambda at, a, b: pd.DataFrame({"i": [at[0]], "j": [at[1]], "n": [len(a) + len(b)]}),
                       "i int, j int, n long", 100, half=True).toPandas()
    assert len(met) == 55 and (met["i"] <= met["j"]).all() and met["n"].sum() == 11 * 1000


def test_silhouette_estimate(spark, blobs):
    points, df = blobs
    exact = silhouette_samples(df, ["c0", "c1"], "k").toPandas()
    whole = silhouette_estimate(df, ["c0", "c1"], "k").first()
    assert whole["silhouette"] == pytest.approx(exact["silhouette"].mean()) and whole["error"] == 0.0
    assert whole["sampled"] == whole["rows"] == len(points)
    per = {r["k"]: (r["cluster"], r["silhouette"]) for r in exact.to_dict("records")}
    part = silhouette_estimate(df.repartition(5), ["c0", "c1"], "k", targets=30).first()
    sizes = exact["cluster"].value_counts()
    mean = spread = 0.0
    for cluster, n in sizes.items():
        drawn = sorted((k for k, (c, _) in per.items() if c == cluster), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())[:10]
        values = [per[k][1] for k in drawn]
        mean += n * np.mean(values) / len(points)
        spread += n * (n - 10) * np.var(values, ddof=1) / 10 / len(points) ** 2
    assert (part["silhouette"], part["error"]) == pytest.approx((mean, math.sqrt(spread)))
    assert part["sampled"] == 30 and part["low"] < part["silhouette"] < part["high"]
    odd = df.unionByName(df.limit(3).withColumn("cluster", F.lit(None).cast("int"))).unionByName(df.limit(2).withColumn("c0", F.lit(None).cast("double")))
    assert silhouette_estimate(odd, ["c0", "c1"], "k").first()["rows"] == len(points)
    assert silhouette_estimate(df.limit(0), ["c0", "c1"], "k").first()["silhouette"] is None
    with pytest.raises(ValueError):
        silhouette_estimate(df, ["c0", "c1"], "k", targets=5)


def test_validity_ignores_label_names_and_noise(blobs):
    _, df = blobs
    one = centre_indices(df, ["c0", "c1"]).first()
    two = centre_indices(df.withColumn("cluster", 7 - F.col("cluster")), ["c0", "c1"]).first()
    assert tuple(one) == pytest.approx(tuple(two))
    noisy = df.union(df.limit(5).withColumn("cluster", F.lit(-1)))
    assert validity(noisy, ["c0", "c1"], "k", distance="squared")["n"] == 120


def test_no_score_without_two_clusters(blobs):
    _, df = blobs
    for label in (0, -1):
        assert validity(df.withColumn("cluster", F.lit(label)), ["c0", "c1"], "k")["score"] == -math.inf
    assert combine_scores(-1.0, 0.0, math.inf) == pytest.approx(-1 / 3)


def test_centre_methods_split_standardised_data(blobs):
    _, df = blobs
    scaled = standardize(df.drop("cluster"), ["c0", "c1"])
    for method in (kmeans, bisecting_kmeans):
        labelled = method(scaled, ["c0_z", "c1_z"], 3)
        assert sorted(r["count"] for r in labelled.groupBy("cluster").count().collect()) == [40, 40, 40]


def test_the_cluster_of_most_rows_is_split_last(spark):
    """Two places of 100 rows each against nine of two rows: equal rows are one point of the fit, and still count as rows."""
    heavy = [(x, 0.0) for x in (0.0, 1.0) for _ in range(100)]
    light = [(50.0 + x, float(y)) for x in range(3) for y in range(3) for _ in range(2)]
    df = spark.createDataFrame([*heavy, *light, (None, 1.0), (math.nan, 1.0)], "a double, b double")
    got = bisecting_kmeans(df, ["a", "b"], 3).groupBy("a", "b", "cluster").count().collect()
    place = {(r["a"], r["b"]): r["cluster"] for r in got}
    assert sum(r["count"] for r in got) == 218 and len(got) == len(place) == 11
    assert place[0.0, 0.0] != place[1.0, 0.0] and len({c for (a, _), c in place.items() if a >= 50}) == 1


def test_few_places_and_no_rows(spark):
    df = spark.createDataFrame([(float(i % 2), 5.0) for i in range(20)], "a double, b double")
    labelled = bisecting_kmeans(df, ["a", "b"], 4)
    assert sorted((r["cluster"], r["count"]) for r in labelled.groupBy("cluster").count().collect()) == [(0, 10), (1, 10)]
    assert bisecting_kmeans(df.where("a > 5"), ["a", "b"], 4).count() == 0


def test_a_fit_reads_each_place_once(spark, monkeypatch):
    """Copies of rows make the tables that the rounds of a fit read no larger."""
    read = []
    monkeypatch.setattr(clustering, "written", lambda df: read.append(df.count()) or written(df))
    df = spark.range(3000).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    for method in (kmeans, bisecting_kmeans):
        assert sum(r["count"] for r in method(df, ["a", "b"], 3).groupBy("cluster").count().collect()) == 3000
    assert read == [35, 35]


def test_model_search(blobs, spark):
    _, df = blobs
    found = auto_cluster(df.drop("cluster"), ["c0", "c1"], "k", trials=1, max_clusters=4, distance="squared")
    assert found.score > 0.7 and found.labelled.count() == 120
    assert {r["algorithm"] for r in found.trials.collect()} == {"kmeans", "bisecting", "density", "single linkage"}
    empty = auto_cluster(df.drop("cluster").limit(0), ["c0", "c1"], "k")
    assert empty.labelled is None and empty.score == -math.inf


def test_cluster_limits():
    assert [cluster_limit(n) for n in (1, 3, 10, 100)] == [4, 4, 6, 21]
    assert cluster_limit(100, 7) == 7
