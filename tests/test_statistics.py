import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from engagelake.operators import correlation
from engagelake.operators.correlation import correlation_matrix, kendall_rows, weighted_dominance
from engagelake.operators.describe import column_profile, describe, describe_long, variation
from engagelake.operators.distribution import (
    boxplot,
    durbin_watson,
    histogram,
    jarque_bera,
    kolmogorov_smirnov,
    standardize,
    two_series,
    zscore_filter,
)
from engagelake.operators.frequency import (
    collect_per_group,
    group_sizes,
    latest_per_owner,
    pivot_sizes,
    sample_per_group,
    shares,
    top_n,
    value_counts,
    weekday_table,
)
from engagelake.operators.ordering import Blocks, dense_index, exact_quantiles, find_blocks
from engagelake.operators.regression import (
    fit_linear,
    predict,
    regression_metrics,
    residual_report,
    simple_ols,
    train_test_split,
)

# One value holds 40 % of p; a third of the rows are in one group; q has nulls and ties.
RNG = np.random.default_rng(0)
N = 1500
P = np.where(RNG.random(N) < 0.4, 7, RNG.integers(0, 200, N)).astype(float)
FRAME = pd.DataFrame({"p": P, "q": RNG.normal(size=N).round(1) + P / 50, "r": RNG.random(N), "g": np.where(np.arange(N) % 3 == 0, 0, P % 4)})
FRAME.loc[::17, "q"] = np.nan
BLOCKS = [10**6, 100]


@pytest.fixture(scope="module")
def skewed(spark):
    df = spark.createDataFrame(FRAME.assign(k=np.arange(N)))
    return df.withColumn("q", F.when(~F.isnan("q"), F.col("q"))).repartition(6).cache()


def tau(x, y):
    keep = ~(np.isnan(x) | np.isnan(y))
    s, t = (np.sign(v[keep][:, None] - v[keep][None]) for v in (x, y))
    return (s * t).sum() / np.sqrt((s * s).sum() * (t * t).sum())


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("method", ["pearson", "spearman", "kendall"])
def test_correlation_against_brute_force(skewed, method, block_rows):
    columns = ["p", "q", "r"]
    got = {(r["column_a"], r["column_b"]): r["r"] for r in correlation_matrix(skewed, columns, method, block_rows).collect()}
    assert len(got) == 9
    for a in columns:
        assert got[a, a] == 1.0
        for b in columns:
            pair = FRAME[[a, b]].dropna() if a != b else None
            assert got[a, b] == got[b, a]
            if pair is None:
                continue
            expected = {"pearson": lambda: pair.corr().iloc[0, 1], "spearman": lambda: pair.rank().corr().iloc[0, 1],
                        "kendall": lambda: tau(FRAME[a].to_numpy(), FRAME[b].to_numpy())}[method]()
            assert got[a, b] == pytest.approx(expected, abs=1e-12)


def test_dominance_counts_strict_pairs():
    x, y, c = RNG.integers(0, 9, 60), RNG.integers(0, 9, 60), RNG.integers(1, 4, 60)
    brute = sum(c[i] * c[j] for i in range(60) for j in range(60) if x[i] < x[j] and y[i] < y[j])
    assert weighted_dominance(x, y, c) == brute
    assert weighted_dominance(np.array([1.0]), np.array([1.0]), np.array([5])) == 0


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_exact_quantiles(skewed, block_rows):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    for r in exact_quantiles(skewed, ["p", "q", "r"], probs, block_rows=block_rows).collect():
        assert r["value"] == pytest.approx(FRAME[r["column"]].quantile(r["prob"]), abs=1e-12)
    grouped = exact_quantiles(skewed, ["q", "r"], probs, ["g"], block_rows).collect()
    assert len(grouped) == FRAME["g"].nunique() * 2 * len(probs)
    for r in grouped:
        assert r["value"] == pytest.approx(FRAME[FRAME.g == r["g"]][r["column"]].quantile(r["prob"]), abs=1e-12)


def test_quantiles_between_sketched_bounds(spark):
    """More rows than the sketch tells apart, a hot value, infinities, NaN (the largest) and nulls; windows of few values."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=30_000), np.full(12_000, 0.25), [np.inf] * 40, [-np.inf] * 30, [np.nan] * 900])
    df = spark.createDataFrame(pd.DataFrame({"v": np.nan_to_num(values, nan=1e300, posinf=np.inf, neginf=-np.inf)}))
    df = df.withColumn("v", F.when(F.col("v") == 1e300, F.lit(float("nan"))).otherwise(F.col("v")))
    df = df.unionByName(df.limit(50).withColumn("v", F.lit(None).cast("double"))).repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    ordered = np.sort(values)  # NaN last, as in Spark
    for block_rows in (7, 1_000_000):
        got = {r["prob"]: r["value"] for r in exact_quantiles(df, ["v"], probs, block_rows=block_rows).collect()}
        assert set(got) == set(probs)
        for p in probs:
            at = p * (len(ordered) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            want = low if low == high or at == int(at) else low * (1 - at % 1) + high * (at % 1)
            assert got[p] == pytest.approx(want, abs=1e-9, nan_ok=True), (p, block_rows)


def test_hot_values_get_their_own_block(skewed):
    blocks = find_blocks(skewed, ["p"], 100)
    assert 7.0 in blocks.cuts["p"]
    sizes = {r["b"]: r["count"] for r in blocks.apply(skewed, {"p": "b"}).groupBy("b").count().collect()}
    assert max(n for b, n in sizes.items() if b % 2 == 1) < 200 < max(sizes.values())
    assert Blocks(1, {"p": []}).apply(skewed, {"p": "b"}).select("b").distinct().count() == 1


def test_dense_index_numbers_in_order(spark):
    df = spark.range(0, 3000, 3).repartition(5)
    got = dense_index(df, "id", "i").orderBy("id").collect()
    assert [r["i"] for r in got] == list(range(1000))
    words = dense_index(spark.createDataFrame([(w,) for w in ("b", "a", None, "ç")], "w string"), "w", "i")
    assert {r["w"]: r["i"] for r in words.collect()} == {None: 0, "a": 1, "b": 2, "ç": 3}


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_a_null_group_is_a_group(spark, block_rows):
    rows = [("x" if i % 2 else None, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {g: np.quantile([v for k, v in rows if k == g], [0.25, 0.5, 0.75]) for g in (None, "x")}
    for r in describe(df, ["v"], ["g"], block_rows=block_rows).collect():
        assert [r["25%"], r["50%"], r["75%"]] == pytest.approx(list(want[r["g"]]))
    boxes = {r["g"]: r for r in boxplot(df, ["v"], ["g"], block_rows=block_rows).collect()}
    assert set(boxes) == {None, "x"} and all(boxes[g]["median"] == pytest.approx(want[g][1]) for g in want)


def test_correlation_of_one_and_of_constant_columns(spark):
    df = spark.range(10).selectExpr("cast(id as double) as x", "1.0 as c")
    assert [r["r"] for r in correlation_matrix(df, ["x"]).collect()] == [1.0]
    got = {(r["column_a"], r["column_b"]): r["r"] for r in correlation_matrix(df, ["x", "c"]).collect()}
    assert got["x", "x"] == 1.0 and got["c", "c"] is None


def test_describe(skewed, spark):
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    row = describe(four, ["x"]).first()
    assert (row["count"], row["mean"], row["25%"], row["50%"], row["75%"], row["max"]) == (4, 4.0, 1.75, 2.5, 4.75, 10.0)
    expected = FRAME.groupby("g")["q"].describe()
    for r in describe_long(skewed, ["q"], ["g"], block_rows=100).collect():
        assert r["value"] == pytest.approx(expected.loc[r["g"], r["stat"]])
    assert variation(four, ["x"]).first()["cv"] == pytest.approx(pd.Series([1, 2, 3, 10]).std() / 4)
    profile = column_profile(four).first()
    assert (profile["non_null"], profile["type"], profile["null_share"]) == (4, "double", pytest.approx(0.2))


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_boxplot(spark, block_rows):
    values = list(range(1, 301)) + [1000, 2000, -900]
    row = boxplot(spark.createDataFrame([(float(v),) for v in values], "x double"), ["x"], block_rows=block_rows).first()
    q1, q3 = np.percentile(values, [25, 75])
    inside = [v for v in values if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert (row["q1"], row["q3"], row["whisker_low"], row["whisker_high"], row["outliers"]) == (q1, q3, min(inside), max(inside), 3)


def test_histogram_counts_every_row(skewed, spark):
    bins = histogram(skewed, "r").orderBy("bin").collect()
    counts, edges = np.histogram(FRAME["r"], bins=20)
    assert [b["count"] for b in bins] == list(counts)
    assert [b["from"] for b in bins] == pytest.approx(list(edges[:-1]))
    assert sum(b["count"] for b in histogram(skewed, "q").collect()) == FRAME["q"].count()
    flat = histogram(spark.sql("SELECT 3 AS x FROM range(5)"), "x", 4).collect()
    assert sorted(b["count"] for b in flat) == [0, 0, 0, 5]


def test_zscores(spark):
    df = spark.createDataFrame([(float(i % 5), 1.0) for i in range(100)] + [(100.0, 1.0), (None, 1.0)], "x double, c double")
    assert zscore_filter(df, ["x"]).count() == 100
    z = [r["x_z"] for r in standardize(df.na.drop(), ["x", "c"]).collect()]
    assert np.mean(z) == pytest.approx(0, abs=1e-12) and np.std(z) == pytest.approx(1)
    assert standardize(df, ["c"]).first()["c_z"] == 0.0


def test_normality(spark):
    x = np.random.default_rng(5).normal(size=2000)
    row = jarque_bera(spark.createDataFrame(pd.DataFrame({"x": x})), "x").first()
    z = (x - x.mean()) / x.std()
    jb = len(x) / 6 * ((z**3).mean() ** 2 + ((z**4).mean() - 3) ** 2 / 4)
    assert row["jb"] == pytest.approx(jb) and row["p_value"] == pytest.approx(np.exp(-jb / 2)) and row["normal"]
    assert not jarque_bera(spark.createDataFrame(pd.DataFrame({"x": x**3})), "x").first()["normal"]
    assert kolmogorov_smirnov(spark.createDataFrame(pd.DataFrame({"x": x})), "x").first()["normal"]


@pytest.mark.parametrize("block_rows", [10**6, 50])
def test_durbin_watson(spark, block_rows):
    four = spark.createDataFrame([(i, 0, e) for i, e in enumerate([1.0, -1.0, 1.0, -1.0])], "o int, t int, e double")
    assert durbin_watson(four, "e", "o", ["t"]).first()["durbin_watson"] == 3.0
    order = np.where(RNG.random(600) < 0.4, 50, RNG.integers(0, 100, 600))
    frame = pd.DataFrame({"o": order, "t": RNG.permutation(600), "e": RNG.normal(size=600).cumsum()})
    e = frame.sort_values(["o", "t"])["e"].to_numpy()
    got = durbin_watson(spark.createDataFrame(frame).repartition(5), "e", "o", ["t"], block_rows).first()
    assert got["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    assert got["n"] == 600


def test_counts_pivots_and_tops(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', 'x', 1.0), ('a', 'x', NULL), ('a', 'y', 3.0), ('b', 'x', 3.0), (NULL, 'x', 2.0)
        AS t(k, c, m)""")
    assert [tuple(r) for r in value_counts(df, "k").collect()] == [("a", 3), ("b", 1)]
    assert group_sizes(df, ["k", "c"]).count() == 3
    wide = {r["k"]: (r["x"], r["y"]) for r in pivot_sizes(df, "k", "c", ["x", "y"]).collect()}
    assert wide == {"a": (2, 1), "b": (1, None)}
    assert pivot_sizes(df, "k", "c", ["x", "y"], fill=0).where("k = 'b'").first()["y"] == 0
    assert [r["share"] for r in shares(value_counts(df, "k")).collect()] == [75.0, 25.0]
    assert [tuple(r)[0::2] for r in top_n(df.where("k IS NOT NULL"), "m", "k", 3).collect()] == [("a", 3.0), ("b", 3.0), ("a", 1.0)]
    assert top_n(df, "m", "c", 9).collect()[-1]["m"] is None
    assert two_series(df, "c", "m", "k").first()["m"] == 3.0


def test_weekdays(spark):
    df = spark.sql("""SELECT * FROM VALUES (timestamp_ntz'2024-01-07', 'FEED'), (timestamp_ntz'2024-01-01', 'REELS') AS t(d, k)""")
    rows = weekday_table(df, "d", "k", ["FEED", "REELS"]).collect()
    assert [(r["dia"], r["FEED"], r["REELS"]) for r in rows] == [("Segunda-feira", None, 1), ("Domingo", 1, None)]


def test_bounded_groups(spark):
    df = spark.range(100).selectExpr("id", "id % 2 AS ownerId", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,CAST(id AS INT)) AS data_hora")
    assert {r["id"] for r in latest_per_owner(df, 2).collect()} == {96, 97, 98, 99}
    plan = latest_per_owner(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    one, two = (sorted(r["id"] for r in sample_per_group(d, "ownerId", "id", 10).collect()) for d in (df, df.repartition(9)))
    assert one == two and len(one) == 20
    parts = collect_per_group(df, "ownerId", "id", "id", chunk=10).collect()
    assert sorted(v for r in parts for v in r["values"]) == list(range(100)) and len(parts) > 4


def test_large_groups_are_not_gathered(spark):
    """Rows go to their part at once, not to the task of their group first, without broadcasts by estimated size too."""
    df = spark.range(100).selectExpr("id", "if(id % 2 = 0, 1, null) AS g", "if(id % 4 = 1, null, id) AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = collect_per_group(df, "g", "v", "id", chunk=10)
        plan, rows = parts._jdf.queryExecution().executedPlan().toString(), parts.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning(g" in plan
    assert sorted(v for r in rows for v in r["values"] if v is not None) == [i for i in range(100) if i % 4 != 1]
    assert {g: sum(len(r["values"]) for r in rows if r["g"] == g) for g in (1, None)} == {1: 50, None: 50}


def test_regression(spark):
    x = np.arange(500.0)
    frame = pd.DataFrame({"k": np.arange(500), "x": x, "y": 3 + 2 * x + np.sin(x)})
    df = spark.createDataFrame(frame)
    train, test = train_test_split(df, "k")
    assert train.count() + test.count() == 500 and 60 < test.count() < 140
    assert sorted(r["k"] for r in train.collect()) == sorted(r["k"] for r in train_test_split(df.repartition(7), "k")[0].collect())
    model = simple_ols(df, "x", "y")
    slope, intercept = np.polyfit(x, frame["y"], 1)
    assert (model.first()["slope"], model.first()["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    scored = predict(df, model, "x", "y")
    e = frame["y"] - intercept - slope * x
    got = regression_metrics(scored, "y").first()
    assert got["mae"] == pytest.approx(e.abs().mean()) and got["rmse"] == pytest.approx(np.sqrt((e**2).mean()))
    assert got["r2"] == pytest.approx(1 - (e**2).sum() / ((frame["y"] - frame["y"].mean()) ** 2).sum())
    report = residual_report(scored, "x", ["k"])
    assert report["autocorrelation"].first()["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum())
    assert report["histogram"].count() == 20 and report["residuals"].count() == 500
    fitted, _ = fit_linear(df, ["x", "k"], "y")
    assert fitted.summary.r2 == pytest.approx(got["r2"], abs=1e-6)


def test_no_task_of_kendall_takes_a_whole_column(spark, monkeypatch):
    """Blocks below a million rows too; their pairs are no more than a block, and the value is the same."""
    sizes = []
    points = correlation._dominance_points

    def seen(pairs):
        made = points(pairs)
        sizes.append(max(r["count"] for r in made.groupBy("a", "b", "part", "block").count().collect()))
        return made

    monkeypatch.setattr(correlation, "_dominance_points", seen)
    monkeypatch.setattr(correlation, "KENDALL_ROWS", 5000)
    df = spark.range(40_000).select(F.col("id").cast("double").alias("a"), ((F.col("id") * 7919) % 40_009).cast("double").alias("b"))
    got = {(r["column_a"], r["column_b"]): r["r"] for r in correlation_matrix(df, ["a", "b"], "kendall").collect()}
    assert max(sizes) < 7500
    ids = np.arange(40_000)
    concordant = weighted_dominance(ids, (ids * 7919) % 40_009, np.ones(40_000))
    assert got["a", "b"] == pytest.approx(2 * concordant / (40_000 * 39_999 / 2) - 1)
    assert all((2 * n / kendall_rows(n)) ** 2 <= kendall_rows(n) * 1.001 for n in (10, 10**6, 10**8, 10**10))
