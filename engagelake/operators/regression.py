"""Linear regression with diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engagelake.operators.distribution import durbin_watson, histogram, jarque_bera
from engagelake.schemas import quoted


def split_bucket(key: Column, seed: int = 42) -> Column:
    """0…99 from a digest of the key, the same on every run and partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100


def train_test_split(df: DataFrame, key: str, train_percent: int = 80, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    bucket = split_bucket(quoted(key), seed)
    return df.where(bucket < train_percent), df.where(bucket >= train_percent)


def simple_ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, rows used."""
    a, b = quoted(y).cast("double"), quoted(x).cast("double")
    return df.agg(
        F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_count(a, b).alias("n")
    )


def predict(df: DataFrame, model: DataFrame, x: str, y: str) -> DataFrame:
    """Prediction and residual from a one-row model, taken in as a scalar subquery."""
    line = model.select(F.struct("slope", "intercept")).scalar()
    prediction = line.getField("intercept") + line.getField("slope") * quoted(x).cast("double")
    return df.withColumns({"prediction": prediction, "residual": quoted(y).cast("double") - prediction})


def fit_linear(df: DataFrame, features: list[str], y: str):
    """Least squares on several features; returns the fitted model and the frame it scores."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(
        df.select(*[quoted(f).cast("double").alias(f) for f in features], quoted(y).cast("double").alias("label"))
        .na.drop()
    )
    model = LinearRegression(solver="normal").fit(assembled)
    return model, model.transform(assembled)


def regression_metrics(scored: DataFrame, y: str) -> DataFrame:
    """MAE, MSE, RMSE and R² in one aggregation."""
    e = F.col("residual")
    actual = quoted(y).cast("double")
    sums = scored.where(e.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.var_pop(actual).alias("variance"),
    )
    return sums.select(
        "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
        (1 - F.col("mse") / F.nullif(F.col("variance"), F.lit(0.0))).alias("r2"),
    )


def residual_report(scored: DataFrame, order: str, ties: list[str], bins: int = 20) -> dict[str, DataFrame]:
    """The diagnostic tables: (prediction, residual), histogram, normality, serial correlation."""
    return {
        "residuals": scored.select("prediction", "residual"),
        "histogram": histogram(scored, "residual", bins),
        "normality": jarque_bera(scored, "residual"),
        "autocorrelation": durbin_watson(scored, "residual", order, ties),
    }
