"""Descriptive statistics, correlation, distribution and regression."""

from __future__ import annotations

from pyspark.sql import functions as F

from engagelake.catalog.engagement import gold as gold_plan
from engagelake.catalog.registry import ALL_GOLD, PLAYS, query, rounded
from engagelake.operators.correlation import correlation_matrix
from engagelake.operators.describe import STATS, describe, describe_long, variation
from engagelake.operators.distribution import (
    boxplot,
    durbin_watson,
    histogram,
    jarque_bera,
    kolmogorov_smirnov,
    standardize,
    zscore_filter,
)
from engagelake.operators.regression import (
    fit_linear,
    predict,
    regression_metrics,
    simple_ols,
    split_bucket,
    train_test_split,
)
from engagelake.session import cut_lineage
from engagelake.sources.adapters import plays, table


def gold(spark, folder):
    """Gold as a stored table: the statistics below read it more than once."""
    return cut_lineage(gold_plan(spark, folder))


COLUMNS = ["videoPlayCount", "likesCount", "commentsCount"]


def _describe_sql(source: str, column: str, by: str = "") -> str:
    x = f'CAST("{column}" AS DOUBLE)'
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {key}'{column}' AS "column", count({x}) AS "count", avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min,
       quantile_cont({x}, 0.25) AS "25%", quantile_cont({x}, 0.5) AS "50%", quantile_cont({x}, 0.75) AS "75%", max({x}) AS max
FROM {source}{group}"""


_STAT_LIST = ", ".join(f'round("{s}", 6) + 0.0 AS "{s}"' for s in STATS if s != "count")


@query("describe_plays", f"""
WITH {PLAYS}, d AS ({' UNION ALL '.join(_describe_sql('plays', c) for c in COLUMNS)})
SELECT "column", "count", {_STAT_LIST} FROM d""")
def _describe(spark, folder):
    return rounded(describe(plays(spark, folder), COLUMNS), 6, *[s for s in STATS if s != "count"])


@query("describe_gold", f"""
WITH {ALL_GOLD}, d AS ({' UNION ALL '.join(_describe_sql('gold', c) for c in ['followersCount', '% ENGAJAMENTO', 'RECENCIA'])})
SELECT "column", "count", {_STAT_LIST} FROM d""")
def _describe_gold(spark, folder):
    table_ = describe(gold(spark, folder), ["followersCount", "% ENGAJAMENTO", "RECENCIA"])
    return rounded(table_, 6, *[s for s in STATS if s != "count"])


@query("describe_by_type", f"""
WITH {PLAYS}, d AS ({' UNION ALL '.join(_describe_sql('plays', c, 'type') for c in COLUMNS)})
SELECT type, "column", stat, round(value, 6) + 0.0 AS value FROM (
  {' UNION ALL '.join(f"""SELECT type, "column", '{s}' AS stat, CAST("{s}" AS DOUBLE) AS value FROM d""" for s in STATS)})""")
def _describe_by(spark, folder):
    return rounded(describe_long(plays(spark, folder), COLUMNS, ["type"]), 6, "value")


_SOME_TYPES = """
kinds AS (SELECT * REPLACE (CASE WHEN type = 'A' THEN NULL ELSE type END AS type) FROM plays)"""


def _some_types(spark, folder):
    """Plays with one type turned to null: a null key is a group of its own."""
    return plays(spark, folder).withColumn("type", F.when(F.col("type") != "A", F.col("type")))


@query("describe_null_group", f"""
WITH {PLAYS}, {_SOME_TYPES}, d AS ({' UNION ALL '.join(_describe_sql('kinds', c, 'type') for c in COLUMNS)})
SELECT type, "column", stat, round(value, 6) + 0.0 AS value FROM (
  {' UNION ALL '.join(f"""SELECT type, "column", '{s}' AS stat, CAST("{s}" AS DOUBLE) AS value FROM d""" for s in STATS)})""")
def _describe_null(spark, folder):
    return rounded(describe_long(_some_types(spark, folder), COLUMNS, ["type"], block_rows=5_000), 6, "value")


@query("variation", """
SELECT 'value' AS "column", round(stddev_samp(value) / avg(value), 6) AS cv FROM events
UNION ALL SELECT 'user_id', round(stddev_samp(user_id) / avg(user_id), 6) FROM events""")
def _variation(spark, folder):
    return rounded(variation(table(spark, folder, "events"), ["value", "user_id"]), 6, "cv")


_NUMERIC = ["followersCount", "followsCount", "commentsSum", "likesSum", "RECENCIA"]


def _matrix_sql(pair_sql: str) -> str:
    cells = []
    for i, a in enumerate(_NUMERIC):
        for j, b in enumerate(_NUMERIC):
            r = "1.0" if i == j else f"({pair_sql.format(a=a, b=b)})"
            cells.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round({r}, 6) + 0.0 AS r")
    return f"WITH {ALL_GOLD}, g AS MATERIALIZED (SELECT * FROM gold) " + " UNION ALL ".join(cells)


@query("pearson_matrix", _matrix_sql('SELECT corr("{a}", "{b}") FROM g'))
def _pearson(spark, folder):
    return rounded(correlation_matrix(gold(spark, folder), _NUMERIC), 6, "r")


_RANKED = """SELECT corr(x, y) FROM (
  SELECT rank() OVER (ORDER BY "{a}") + (count(*) OVER (PARTITION BY "{a}") - 1) / 2.0 AS x,
         rank() OVER (ORDER BY "{b}") + (count(*) OVER (PARTITION BY "{b}") - 1) / 2.0 AS y FROM g)"""


@query("spearman_matrix", _matrix_sql(_RANKED))
def _spearman(spark, folder):
    return rounded(correlation_matrix(gold(spark, folder), _NUMERIC, "spearman"), 6, "r")


_TAU = """SELECT sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y))))
  FROM (SELECT "{a}" AS x, "{b}" AS y FROM g) p, (SELECT "{a}" AS x, "{b}" AS y FROM g) q"""


@query("kendall_matrix", _matrix_sql(_TAU))
def _kendall(spark, folder):
    return rounded(correlation_matrix(gold(spark, folder), _NUMERIC, "kendall"), 6, "r")


_PLAY_PAIRS = ["videoPlayCount", "likesCount", "commentsCount"]


@query("pearson_plays", f"""
WITH {PLAYS}, c AS (SELECT corr("videoPlayCount", "likesCount") AS pl, corr("videoPlayCount", "commentsCount") AS pc,
                           corr("likesCount", "commentsCount") AS lc FROM plays)
SELECT column_a, column_b, round(r, 6) + 0.0 AS r FROM (
  SELECT 'videoPlayCount' AS column_a, 'likesCount' AS column_b, pl AS r FROM c
  UNION ALL SELECT 'likesCount', 'videoPlayCount', pl FROM c
  UNION ALL SELECT 'videoPlayCount', 'commentsCount', pc FROM c
  UNION ALL SELECT 'commentsCount', 'videoPlayCount', pc FROM c
  UNION ALL SELECT 'likesCount', 'commentsCount', lc FROM c
  UNION ALL SELECT 'commentsCount', 'likesCount', lc FROM c
  UNION ALL SELECT 'videoPlayCount', 'videoPlayCount', 1.0 UNION ALL SELECT 'likesCount', 'likesCount', 1.0
  UNION ALL SELECT 'commentsCount', 'commentsCount', 1.0)""")
def _pearson_plays(spark, folder):
    return rounded(correlation_matrix(plays(spark, folder), _PLAY_PAIRS), 6, "r")


def _box_sql(by: str = "") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}, c" if by else " GROUP BY c"
    using = f"USING ({by}, c)" if by else "USING (c)"
    return f"""
WITH {PLAYS},
v AS (SELECT {key}'videoPlayCount' AS c, CAST("videoPlayCount" AS DOUBLE) AS x FROM plays
      UNION ALL SELECT {key}'likesCount', CASE WHEN part % 40 = 0 THEN "likesCount" * 10.0 ELSE "likesCount" END FROM plays),
q AS (SELECT {key}c, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM v{group}),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT {key}c AS "column", any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(x) FILTER (x BETWEEN lo AND hi) AS whisker_low, max(x) FILTER (x BETWEEN lo AND hi) AS whisker_high,
       count(*) FILTER (NOT x BETWEEN lo AND hi) AS outliers
FROM v JOIN f {using}{group}"""


def _box_input(spark, folder):
    likes = F.when(F.col("part") % 40 == 0, F.col("likesCount") * 10.0).otherwise(F.col("likesCount"))
    return plays(spark, folder).withColumn("likesCount", likes)


@query("boxplot", _box_sql())
def _boxplot(spark, folder):
    return boxplot(_box_input(spark, folder), ["videoPlayCount", "likesCount"])


@query("boxplot_by_type", _box_sql("type"))
def _boxplot_by(spark, folder):
    return boxplot(_box_input(spark, folder), ["videoPlayCount", "likesCount"], ["type"])


_HIDDEN = _box_sql("type").replace("FROM plays", "FROM (SELECT * REPLACE (CASE WHEN type = 'A' THEN '?' ELSE type END AS type) FROM plays)")


@query("boxplot_null_group", f"""SELECT nullif(type, '?') AS type, * EXCLUDE (type) FROM ({_HIDDEN})""")
def _boxplot_null(spark, folder):
    rows = _box_input(spark, folder).withColumn("type", F.when(F.col("type") != "A", F.col("type")))
    return boxplot(rows, ["videoPlayCount", "likesCount"], ["type"], block_rows=5_000)


def _histogram_sql(source: str, x: str) -> str:
    return f"""
WITH v AS (SELECT CAST({x} AS DOUBLE) AS x FROM {source}), m AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CAST(least(floor((x - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM v, m GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, round(lo + r.range * (hi - lo) / 20, 6) + 0.0 AS "from",
       round(lo + (r.range + 1) * (hi - lo) / 20, 6) + 0.0 AS "to", coalesce(n, 0) AS "count"
FROM range(20) r CROSS JOIN m LEFT JOIN b ON b.bin = r.range"""


@query("histogram", _histogram_sql("events", "value"))
def _histogram(spark, folder):
    return rounded(histogram(table(spark, folder, "events"), "value"), 6, "from", "to")


@query("standardized_metrics", f"""
WITH {ALL_GOLD}, m AS (SELECT avg("followersCount") AS a, stddev_pop("followersCount") AS s, avg("likesSum") AS b,
                              stddev_pop("likesSum") AS t FROM gold)
SELECT id, round(("followersCount" - a) / s, 6) + 0.0 AS "followersCount_z", round(("likesSum" - b) / t, 6) + 0.0 AS "likesSum_z"
FROM gold, m""")
def _standardized(spark, folder):
    scaled = standardize(gold(spark, folder), ["followersCount", "likesSum"])
    return rounded(scaled.select("id", "followersCount_z", "likesSum_z"), 6, "followersCount_z", "likesSum_z")


_MODEL = f"""
{PLAYS},
split AS (SELECT *, CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket FROM plays),
model AS (SELECT regr_slope("likesCount", "videoPlayCount") AS slope, regr_intercept("likesCount", "videoPlayCount") AS intercept,
                 regr_count("likesCount", "videoPlayCount") AS n FROM split WHERE bucket < 80),
scored AS (SELECT split.*, intercept + slope * "videoPlayCount" AS prediction,
                  "likesCount" - (intercept + slope * "videoPlayCount") AS residual FROM split, model)"""


def _fit(spark, folder):
    data = plays(spark, folder)
    train, test = train_test_split(data, "id")
    return data, train, test, simple_ols(train, "videoPlayCount", "likesCount")


@query("train_test_split", f"""
WITH {PLAYS.strip()}, s AS (SELECT CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket FROM plays)
SELECT CASE WHEN bucket < 80 THEN 'train' ELSE 'test' END AS part, count(*) AS "count" FROM s GROUP BY 1""")
def _split(spark, folder):
    part = F.when(split_bucket(F.col("id")) < 80, "train").otherwise("test")
    return plays(spark, folder).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("count"))


@query("ols", f"WITH {_MODEL} SELECT round(slope, 9) AS slope, round(intercept, 6) AS intercept, CAST(n AS BIGINT) AS n FROM model")
def _ols(spark, folder):
    model = _fit(spark, folder)[3]
    return rounded(rounded(model, 9, "slope"), 6, "intercept")


@query("regression_metrics", f"""
WITH {_MODEL}
SELECT count(*) AS n, round(avg(abs(residual)), 6) AS mae, round(avg(residual * residual), 6) AS mse,
       round(sqrt(avg(residual * residual)), 6) AS rmse,
       round(1 - avg(residual * residual) / var_pop("likesCount"), 6) + 0.0 AS r2
FROM scored WHERE bucket >= 80""")
def _metrics(spark, folder):
    _, _, test, model = _fit(spark, folder)
    metrics = regression_metrics(predict(test, model, "videoPlayCount", "likesCount"), "likesCount")
    return rounded(metrics, 6, "mae", "mse", "rmse", "r2")


@query("predictions", f"""
WITH {_MODEL}
SELECT id, part, "videoPlayCount", "likesCount", round(prediction, 6) + 0.0 AS prediction,
       round(residual, 6) + 0.0 AS residual FROM scored""")
def _predictions(spark, folder):
    data, _, _, model = _fit(spark, folder)
    scored = predict(data, model, "videoPlayCount", "likesCount")
    slim = scored.select("id", "part", "videoPlayCount", "likesCount", "prediction", "residual")
    return rounded(slim, 6, "prediction", "residual")


@query("residual_histogram", f"""
WITH {_MODEL}, m AS (SELECT min(residual) AS lo, max(residual) AS hi FROM scored),
b AS (SELECT CAST(least(floor((residual - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS n FROM scored, m GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, coalesce(n, 0) AS "count" FROM range(20) r LEFT JOIN b ON b.bin = r.range""")
def _residual_histogram(spark, folder):
    data, _, _, model = _fit(spark, folder)
    return histogram(predict(data, model, "videoPlayCount", "likesCount"), "residual").select("bin", "count")


@query("residual_normality", f"""
WITH {_MODEL}, m AS (SELECT avg(residual) AS mu, stddev_pop(residual) AS sd FROM scored),
k AS (SELECT count(*) AS n, avg(((residual - mu) / sd) ** 3) AS skewness, avg(((residual - mu) / sd) ** 4) - 3 AS kurtosis
      FROM scored, m),
j AS (SELECT *, n / 6.0 * (skewness ** 2 + kurtosis ** 2 / 4.0) AS jb FROM k)
SELECT n, round(skewness, 6) + 0.0 AS skewness, round(kurtosis, 6) + 0.0 AS kurtosis, round(jb, 3) + 0.0 AS jb,
       round(exp(-jb / 2), 6) + 0.0 AS p_value, exp(-jb / 2) > 0.05 AS normal FROM j""")
def _normality(spark, folder):
    data, _, _, model = _fit(spark, folder)
    report = jarque_bera(predict(data, model, "videoPlayCount", "likesCount"), "residual")
    return rounded(rounded(report, 6, "skewness", "kurtosis", "p_value"), 3, "jb")


@query("residual_autocorrelation", f"""
WITH {_MODEL},
steps AS (SELECT residual, residual - lag(residual) OVER (ORDER BY data_hora, id, part, "videoPlayCount", "likesCount") AS step
          FROM scored)
SELECT count(*) AS n, round(sum(step * step) / sum(residual * residual), 6) AS durbin_watson,
       sum(step * step) / sum(residual * residual) > 1.5 AND sum(step * step) / sum(residual * residual) < 2.5 AS uncorrelated
FROM steps""")
def _autocorrelation(spark, folder):
    data, _, _, model = _fit(spark, folder)
    day = F.timestamp_diff("DAY", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("data_hora"))
    scored = predict(data, model, "videoPlayCount", "likesCount").withColumn("day", day)
    report = durbin_watson(scored, "residual", "day", ["id", "part", "videoPlayCount", "likesCount"])
    return rounded(report, 6, "durbin_watson")


@query("outlier_free_regression", f"""
WITH {PLAYS}, m AS (SELECT avg("videoPlayCount") AS a, stddev_pop("videoPlayCount") AS s, avg("likesCount") AS b,
                           stddev_pop("likesCount") AS t FROM plays),
kept AS (SELECT plays.* FROM plays, m WHERE abs(("videoPlayCount" - a) / s) < 3 AND abs(("likesCount" - b) / t) < 3)
SELECT round(regr_slope("likesCount", "videoPlayCount"), 9) AS slope,
       round(regr_intercept("likesCount", "videoPlayCount"), 6) AS intercept,
       CAST(regr_count("likesCount", "videoPlayCount") AS BIGINT) AS n FROM kept""")
def _outlier_free(spark, folder):
    kept = zscore_filter(plays(spark, folder), ["videoPlayCount", "likesCount"])
    return rounded(rounded(simple_ols(kept, "videoPlayCount", "likesCount"), 9, "slope"), 6, "intercept")


@query("residual_ks_test")
def _ks(spark, folder):
    data, _, _, model = _fit(spark, folder)
    return kolmogorov_smirnov(predict(data, model, "videoPlayCount", "likesCount"), "residual")


# Normal equations of three features, solved by determinants over their covariances.
_SEVERAL = """
m AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac, covar_pop(b, b) AS bb, covar_pop(b, c) AS bc,
             covar_pop(c, c) AS cc, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, covar_pop(c, y) AS cy,
             avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(y) AS my
      FROM (SELECT CAST("videoPlayCount" AS DOUBLE) AS a, CAST("commentsCount" AS DOUBLE) AS b, CAST("videoDuration" AS DOUBLE) AS c,
                   CAST("likesCount" AS DOUBLE) AS y FROM plays)),
d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m),
k AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / det AS ka,
             (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / det AS kb,
             (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / det AS kc FROM d)"""


@query("several_feature_regression", f"""
WITH {PLAYS}, {_SEVERAL}
SELECT term, round(coefficient, 6) + 0.0 AS coefficient FROM (
  SELECT 'videoPlayCount' AS term, ka AS coefficient FROM k UNION ALL SELECT 'commentsCount', kb FROM k
  UNION ALL SELECT 'videoDuration', kc FROM k UNION ALL SELECT 'intercept', my - ka * ma - kb * mb - kc * mc FROM k)""")
def _several(spark, folder):
    features = ["videoPlayCount", "commentsCount", "videoDuration"]
    model, _ = fit_linear(plays(spark, folder), features, "likesCount")
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients)] + [("intercept", float(model.intercept))]
    return rounded(spark.createDataFrame(rows, "term string, coefficient double"), 6, "coefficient")
