"""Dimension reduction, clustering and validity."""

from __future__ import annotations

from pyspark.sql import functions as F

from engagelake.catalog.engagement import gold as gold_plan
from engagelake.catalog.registry import ALL_GOLD, PLAYS, query, rounded
from engagelake.operators.clustering import (
    auto_cluster,
    bisecting_kmeans,
    centre_indices,
    kmeans,
    silhouette_estimate,
    silhouette_samples,
    silhouette_squared,
    validity,
)
from engagelake.operators.components import principal_components
from engagelake.operators.density import core_points, dbscan, single_linkage
from engagelake.operators.describe import STATS, describe_long
from engagelake.operators.distribution import standardize
from engagelake.operators.frequency import value_counts
from engagelake.operators.gold import cluster_table
from engagelake.operators.linkage import cut_at, merge_list
from engagelake.session import cut_lineage
from engagelake.sources.adapters import plays, table

METRICS = ["commentsCount", "likesCount", "videoPlayCount", "videoDuration"]


@query("principal_components")
def _scores(spark, folder):
    scores, _, _ = principal_components(plays(spark, folder), METRICS)
    return scores.select("id", F.round("PC1", 6).alias("PC1"), F.round("PC2", 6).alias("PC2"))


@query("explained_variance")
def _variance(spark, folder):
    return rounded(principal_components(plays(spark, folder), METRICS)[1], 6, "explained", "cumulative")


@query("explained_variance_of_two", f"""
WITH {PLAYS}, c AS (SELECT abs(corr("videoPlayCount", "likesCount")) AS r FROM plays)
SELECT 'PC1' AS component, round((1 + r) / 2, 6) AS explained, round((1 + r) / 2, 6) AS cumulative FROM c
UNION ALL SELECT 'PC2', round((1 - r) / 2, 6), 1.0 FROM c""")
def _variance_of_two(spark, folder):
    """Two standardised columns have shares of 1 ± r."""
    return rounded(principal_components(plays(spark, folder), ["videoPlayCount", "likesCount"])[1], 6, "explained", "cumulative")


@query("component_loadings")
def _loadings(spark, folder):
    return rounded(principal_components(plays(spark, folder), METRICS)[2], 6, "PC1", "PC2")


@query("cumulative_shares", """
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, round(sum(n) OVER (ORDER BY event_type) / (SELECT sum(n) FROM c), 6) AS cumulative FROM c""")
def _cumulative(spark, folder):
    from pyspark.sql import Window

    sizes = table(spark, folder, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("event_type").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = sizes.agg(F.sum("n")).scalar()
    return sizes.select("event_type", F.round(upto / total, 6).alias("cumulative"))


@query("kmeans_clusters")
def _kmeans(spark, folder):
    scaled = standardize(plays(spark, folder), ["likesCount", "videoPlayCount"])
    return value_counts(kmeans(scaled, ["likesCount_z", "videoPlayCount_z"], 5), "cluster")


@query("bisecting_clusters")
def _bisecting(spark, folder):
    scaled = standardize(plays(spark, folder), ["likesCount", "videoPlayCount"])
    return value_counts(bisecting_kmeans(scaled, ["likesCount_z", "videoPlayCount_z"], 5), "cluster")


def active(spark, folder):
    """All profiles with two metrics in half units, exact numbers in both engines; text ids as keys."""
    return gold_plan(spark, folder).select(
        "id",
        (F.floor(F.col("followersCount") / 100) / 2.0).alias("u"),
        (F.floor(F.col("count") / 2) / 2.0).alias("v"),
    )


_ACTIVE = f"""{ALL_GOLD},
pts AS MATERIALIZED (SELECT id, floor("followersCount" / 100) / 2.0 AS u, floor("count" / 2) / 2.0 AS v
        FROM gold),
near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM pts a, pts b
         WHERE (a.u - b.u) ** 2 + (a.v - b.v) ** 2 <= 1.0),
core AS MATERIALIZED (SELECT a AS id FROM near GROUP BY 1 HAVING count(*) >= 6)"""


@query("density_core_points", f"""
WITH {_ACTIVE} SELECT pts.id, core.id IS NOT NULL AS is_core FROM pts LEFT JOIN core ON pts.id = core.id""")
def _core(spark, folder):
    return core_points(active(spark, folder), ["u", "v"], "id", 1.0, 6).select(F.col("key").alias("id"), "is_core")


_COMPONENT = f"""
WITH RECURSIVE {_ACTIVE},
links AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(id, root) AS (
  SELECT id, id FROM core
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id WHERE r.root < l.b),
label AS (SELECT id, min(root) AS root FROM reach GROUP BY 1),
number AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM label)),
coreno AS (SELECT id, cluster FROM label JOIN number USING (root)),
border AS (SELECT near.a AS id, min(c.cluster) AS cluster FROM near JOIN coreno c ON near.b = c.id
           WHERE near.a NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT pts.id, c.id IS NOT NULL AS is_core, coalesce(c.cluster, b.cluster, -1) AS cluster
FROM pts LEFT JOIN coreno c ON pts.id = c.id LEFT JOIN border b ON pts.id = b.id"""


@query("density_clusters", _COMPONENT)
def _dbscan(spark, folder):
    return dbscan(active(spark, folder), ["u", "v"], "id", 1.0, 6)


@query("single_linkage_clusters", _COMPONENT.replace("count(*) >= 6", "count(*) >= 1"))
def _single(spark, folder):
    return single_linkage(active(spark, folder), ["u", "v"], "id", 1.0)


_LINKS = """
WITH RECURSIVE pts AS MATERIALIZED (SELECT s_suppkey AS id, s_acctbal / 500.0 AS u, CAST(s_nationkey AS DOUBLE) AS v FROM supplier),
pairs AS MATERIALIZED (SELECT a.id AS x, b.id AS y, sqrt((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS w FROM pts a JOIN pts b ON a.id < b.id),
state(step, id, grp, p, q, height) AS (
  SELECT 0, id, id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE) FROM pts
  UNION ALL
  SELECT s.step + 1, s.id, CASE WHEN s.grp = greatest(e.g, e.h) THEN least(e.g, e.h) ELSE s.grp END, least(e.g, e.h), greatest(e.g, e.h), e.w
  FROM state s, (SELECT l.grp AS g, r.grp AS h, w FROM pairs JOIN state l ON l.id = x JOIN state r ON r.id = y
                 WHERE l.grp <> r.grp ORDER BY w, x, y LIMIT 1) e)
SELECT CAST(step - 1 AS BIGINT) AS step, any_value(p) AS a, any_value(q) AS b, round(any_value(height), 6) AS height,
       count(*) FILTER (grp = p) AS size FROM state WHERE step > 0 GROUP BY step"""


@query("linkage_merges", _LINKS)
def _linkage(spark, folder):
    """All single-linkage merges of the suppliers, by balance and nation."""
    points = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("bigint").alias("id"), (F.col("s_acctbal") / 500.0).alias("u"), F.col("s_nationkey").cast("double").alias("v"))
    return rounded(merge_list(points, ["u", "v"], "id"), 6, "height")


@query("linkage_cut", _COMPONENT.replace("count(*) >= 6", "count(*) >= 1").replace(
    "SELECT pts.id, c.id IS NOT NULL AS is_core, coalesce(c.cluster, b.cluster, -1) AS cluster\nFROM pts LEFT JOIN coreno c ON pts.id = c.id LEFT JOIN border b ON pts.id = b.id",
    "SELECT id, root AS component FROM label"))
def _linkage_cut(spark, folder):
    """The components of the profiles at one height of their merge list."""
    points = cut_lineage(active(spark, folder))
    merges = merge_list(points, ["u", "v"], "id")
    return cut_at(merges, points.select(F.col("id").alias("topic")), height=1.0).select(F.col("topic").alias("id"), F.col("root").alias("component"))


def vectors(spark, folder):
    """Embeddings with one column per dimension and the given label as cluster."""
    raw = table(spark, folder, "embeddings")
    return raw.select(
        "vec_id", F.col("label").cast("bigint").alias("cluster"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)],
    )


DIMENSIONS = [f"e{i}" for i in range(64)]
_POINTS = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS c, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _silhouette_sql(distance: str) -> str:
    return f"""
{_POINTS},
size AS (SELECT c, count(*) AS n FROM e GROUP BY 1),
pair AS (SELECT a.vec_id, a.c, b.c AS other, sum({distance}) AS total FROM e a, e b GROUP BY 1, 2, 3),
mean AS (SELECT vec_id, pair.c, other, total / CASE WHEN pair.c = other THEN n - 1 ELSE n END AS m
         FROM pair JOIN size ON size.c = other),
side AS (SELECT vec_id, c, max(m) FILTER (c = other) AS a, min(m) FILTER (c <> other) AS b FROM mean GROUP BY 1, 2),
sil AS (SELECT vec_id, c, (b - a) / greatest(a, b) AS s FROM side)"""


_CENTRES = f"""
{_POINTS},
long AS (SELECT vec_id, c, unnest(v) AS x, unnest(range(64)) AS d FROM e),
centre AS (SELECT c, d, avg(x) AS m, count(*) AS n FROM long GROUP BY 1, 2),
grand AS (SELECT d, avg(x) AS g FROM long GROUP BY 1),
away AS (SELECT vec_id, l.c, sum((x - m) ** 2) AS q FROM long l JOIN centre USING (c, d) GROUP BY 1, 2),
radius AS (SELECT c, avg(sqrt(q)) AS r, sum(q) AS w, count(*) AS n FROM away GROUP BY 1),
apart AS (SELECT a.c AS i, b.c AS j, sqrt(sum((a.m - b.m) ** 2)) AS dist FROM centre a JOIN centre b USING (d)
          WHERE a.c <> b.c GROUP BY 1, 2),
worst AS (SELECT i, max((p.r + q.r) / dist) AS v FROM apart JOIN radius p ON p.c = i JOIN radius q ON q.c = j GROUP BY 1),
idx AS (SELECT (SELECT sum(n * (m - g) ** 2) FROM centre JOIN grand USING (d)) / (count(*) - 1)
               / (sum(w) / (sum(n) - count(*))) AS ch,
               (SELECT avg(v) FROM worst) AS db, count(*) AS k, CAST(sum(n) AS BIGINT) AS n FROM radius)"""


@query("silhouette_samples", f"""
WITH {_silhouette_sql('list_distance(a.v, b.v)')} SELECT vec_id, c AS cluster, round(s, 6) + 0.0 AS silhouette FROM sil""")
def _silhouettes(spark, folder):
    return rounded(silhouette_samples(vectors(spark, folder), DIMENSIONS, "vec_id"), 6, "silhouette")


@query("silhouette_squared", f"""
WITH {_silhouette_sql('list_distance(a.v, b.v) ** 2')} SELECT round(avg(s), 6) + 0.0 AS silhouette FROM sil""")
def _squared(spark, folder):
    value = silhouette_squared(vectors(spark, folder), DIMENSIONS)
    return spark.createDataFrame([(round(value, 6),)], "silhouette double")


# Few drawn rows, so that the sample differs from the whole in small tables too.
_DRAWN = 60


@query("silhouette_estimate", f"""
WITH {_silhouette_sql('list_distance(a.v, b.v)')},
drawn AS (SELECT vec_id, c, s FROM sil QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id)
          <= {_DRAWN} // (SELECT count(*) FROM size)),
strata AS (SELECT c, count(*) AS m, avg(s) AS mean, var_samp(s) AS variance FROM drawn GROUP BY 1),
spread AS (SELECT m, n, mean, CASE WHEN m = n THEN 0 ELSE n * (n - m) * variance / m END AS v FROM strata JOIN size USING (c)),
one AS (SELECT sum(n * mean) / sum(n) AS s, CASE WHEN count(v) = count(*) THEN sqrt(sum(v)) / sum(n) END AS e,
               CAST(sum(m) AS BIGINT) AS m, CAST(sum(n) AS BIGINT) AS n FROM spread)
SELECT round(s, 6) + 0.0 AS silhouette, round(e, 6) + 0.0 AS error, round(s - 1.959964 * e, 6) + 0.0 AS low,
       round(s + 1.959964 * e, 6) + 0.0 AS high, m AS sampled, n AS rows FROM one""")
def _estimate(spark, folder):
    found = silhouette_estimate(vectors(spark, folder), DIMENSIONS, "vec_id", targets=_DRAWN)
    return rounded(found, 6, "silhouette", "error", "low", "high")


@query("centre_indices", f"""
WITH {_CENTRES} SELECT n, k AS clusters, round(ch, 6) AS calinski_harabasz, round(db, 6) AS davies_bouldin FROM idx""")
def _centres(spark, folder):
    return rounded(centre_indices(vectors(spark, folder), DIMENSIONS), 6, "calinski_harabasz", "davies_bouldin")


@query("validity_score", f"""
WITH {_silhouette_sql('list_distance(a.v, b.v)')}, {_CENTRES.replace(_POINTS + ',', '')}
SELECT k AS clusters, n, round((SELECT avg(s) FROM sil), 6) + 0.0 AS silhouette,
       round(((SELECT avg(s) FROM sil) + (1 - 2 / (exp(2 * ch / 10000) + 1)) + (1 - 2 / (exp(2 / db) + 1))) / 3, 6) AS score
FROM idx""")
def _validity(spark, folder):
    found = validity(vectors(spark, folder), DIMENSIONS, "vec_id")
    row = (found["clusters"], found["n"], round(found["silhouette"], 6), round(found["score"], 6))
    return spark.createDataFrame([row], "clusters bigint, n bigint, silhouette double, score double")


@query("cluster_sizes", """SELECT CAST(label AS BIGINT) AS cluster, count(*) AS "count" FROM embeddings GROUP BY 1""")
def _cluster_sizes(spark, folder):
    return value_counts(vectors(spark, folder), "cluster")


_STAT = {"count": "count(x)", "mean": "avg(x)", "std": "stddev_samp(x)", "min": "min(x)", "25%": "quantile_cont(x, 0.25)",
         "50%": "quantile_cont(x, 0.5)", "75%": "quantile_cont(x, 0.75)", "max": "max(x)"}


@query("cluster_profile", f"""
WITH e AS (SELECT CAST(label AS BIGINT) AS cluster, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)
{' UNION ALL '.join(f"SELECT cluster, 'e0' AS column, '{s}' AS stat, round({_STAT[s]}, 6) + 0.0 AS value FROM e GROUP BY 1" for s in STATS)}""")
def _cluster_profile(spark, folder):
    return rounded(describe_long(vectors(spark, folder), ["e0"], ["cluster"]), 6, "value")


@query("cluster_table", """
SELECT CAST(vec_id AS VARCHAR) AS id, 'vec' || CAST(vec_id AS VARCHAR) AS username, CAST(label AS BIGINT) AS cluster_label,
       'KMeans' AS cluster_algo, CAST(0.5 AS DOUBLE) AS cluster_score, 'r1' AS _run_id FROM embeddings""")
def _cluster_table(spark, folder):
    named = vectors(spark, folder).withColumn("name", F.concat(F.lit("vec"), F.col("vec_id").cast("string")))
    return cluster_table(named, "KMeans", 0.5, "r1", "vec_id", "name").drop("_generated_at")


@query("model_selection")
def _selection(spark, folder):
    scores = cut_lineage(active(spark, folder))
    return auto_cluster(scores, ["u", "v"], "id", trials=1, distance="squared").trials
