"""Sentiment: a pluggable batch scorer, a default one, and the distribution reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engagelake.functions.casts import round_even
from engagelake.operators.frequency import pivot_sizes, top_n
from engagelake.schemas import quoted

CLASSES = ["negative", "neutral", "positive"]
Predictor = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


def scorer(load: Callable[[], Predictor]):
    """Column function text -> struct(label, score).

    ``load`` runs on the worker, once per task; the predictor it returns gets whole texts in Arrow batches and
    cuts them itself if its model has an input limit. Null or blank text, or a text the model fails on, gives
    a null pair. A model that fails on every one of several texts of a task fails the job.
    """

    @F.pandas_udf("label string, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict, seen, failed = load(), 0, []
        for batch in batches:
            out = pd.DataFrame({"label": None, "score": None}, index=batch.index, dtype="object")
            usable = batch[batch.notna() & (batch.str.strip() != "")]
            try:
                found = list(predict(usable.tolist())) if len(usable) else []
                if len(found) != len(usable):
                    raise ValueError("one result per text expected")
            except Exception:
                found = [_predict_one(predict, text, failed) for text in usable]
            seen += len(usable)
            out.loc[usable.index, "label"] = [label for label, _ in found]
            out.loc[usable.index, "score"] = [score for _, score in found]
            yield out.astype({"score": "float64"})
        if seen > 1 and len(failed) == seen:
            raise RuntimeError(f"the model failed on all {seen} texts of a task") from failed[-1]

    return udf


def _predict_one(predict: Predictor, text: str, failed: list[Exception]) -> tuple[str | None, float | None]:
    try:
        return predict([text])[0]
    except Exception as error:
        failed.append(error)
        return None, None


def with_sentiment(comments: DataFrame, load: Callable[[], Predictor], text: str = "text") -> DataFrame:
    """Add lower-case ``sentiment_label`` and ``sentiment_score``."""
    scored = comments.withColumn("__s", scorer(load)(quoted(text)))
    return scored.withColumns(
        {"sentiment_label": F.lower("__s.label"), "sentiment_score": F.col("__s.score")}
    ).drop("__s")


def train_default(labelled: DataFrame, text: str = "text", label: str = "sentiment_label", features: int = 1 << 14):
    """Hashed TF-IDF and logistic regression, trained on a labelled table."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer

    rows = labelled.where(quoted(text).isNotNull() & quoted(label).isNotNull())
    stages = [
        StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc"),
        RegexTokenizer(inputCol=text, outputCol="__w", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False),
        HashingTF(inputCol="__w", outputCol="__tf", numFeatures=features),
        IDF(inputCol="__tf", outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=30, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def apply_default(model, comments: DataFrame, text: str = "text") -> DataFrame:
    """Score with the default model; the score is the probability of the chosen class."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array

    classes = F.array(*[F.lit(c) for c in model.stages[0].labels])
    scored = PipelineModel(model.stages[1:]).transform(comments.withColumn(text, F.coalesce(quoted(text), F.lit(""))))
    usable = F.trim(quoted(text)) != ""
    return scored.withColumns(
        {
            "sentiment_label": F.when(usable, F.lower(F.get(classes, F.col("prediction").cast("int")))),
            "sentiment_score": F.when(usable, F.array_max(vector_to_array("probability"))),
        }
    ).drop("__w", "__tf", "__x", "rawPrediction", "probability", "prediction")


def sentiment_by(comments: DataFrame, key: str, fill: int | None = None) -> DataFrame:
    """Per key: comments per class, their total and percentages; null where a class is missing."""
    lowered = comments.withColumn("sentiment_label", F.lower("sentiment_label")).where(
        F.col("sentiment_label").isNotNull()
    )
    table = pivot_sizes(lowered, key, "sentiment_label", CLASSES, fill)
    total = F.col("negative") + F.col("positive") + F.col("neutral")

    def percent(name: str) -> Column:
        return round_even(F.col(name) / F.nullif(F.col("Qtd Comentários"), F.lit(0)) * 100, 2)

    return table.withColumn("Qtd Comentários", total).withColumns({f"% {c}": percent(c) for c in CLASSES})


def top_by_class(table: DataFrame, key: str, sentiment: str, n: int = 5) -> DataFrame:
    """The n keys with the largest share of a class."""
    return top_n(table.select(quoted(key), quoted(f"% {sentiment}")), f"% {sentiment}", key, n)
