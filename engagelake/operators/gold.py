"""Gold tables: engagement per profile, sentiment, clusters, topics."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engagelake.functions.casts import ratio
from engagelake.functions.dates import whole_days
from engagelake.schemas import GOLD_CLUSTERS, GOLD_SENTIMENT, GOLD_TOPICS, conform, quoted


def combined_posts(posts: DataFrame, reels: DataFrame) -> DataFrame:
    """Union by name; a column of one side only is null on the other."""
    return posts.unionByName(reels, allowMissingColumns=True)


def owner_totals(publications: DataFrame) -> DataFrame:
    """Sums, first and last time and count per (owner id, owner name); null keys are left out."""
    return (
        publications.where(F.col("ownerId").isNotNull() & F.col("ownerUsername").isNotNull())
        .groupBy("ownerId", "ownerUsername")
        .agg(
            F.coalesce(F.sum("commentsCount"), F.lit(0)).alias("commentsSum"),
            F.coalesce(F.sum("likesCount"), F.lit(0)).alias("likesSum"),
            F.min("data_hora").alias("minData"),
            F.max("data_hora").alias("maxData"),
            F.count(F.lit(1)).alias("count"),
        )
    )


def latest_time(joined: DataFrame) -> Column:
    """The newest post over all profiles, as a scalar subquery.

    It sums the same totals as the main branch, so both branches have one and the same aggregation below
    the join and Spark reuses its shuffle; asking for the maximum alone would prune it to a different one.
    """
    summary = F.struct(
        F.max("maxData").alias("latest"), F.min("minData"), F.sum("commentsSum"), F.sum("likesSum"), F.sum("count")
    )
    return joined.agg(summary.alias("summary")).scalar().getField("latest")


def _strict_ratio(total: Column, followers: Column) -> Column:
    by_zero = (
        F.when(total > 0, F.lit(float("inf"))).when(total < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    )
    return F.when(followers == 0, F.when(total.isNotNull(), by_zero)).otherwise(
        total.cast("double") / F.nullif(followers, F.lit(0)).cast("double")
    )


def engagement(
    profiles: DataFrame,
    posts: DataFrame,
    reels: DataFrame,
    run_id: str | None = None,
    generated_at: datetime | None = None,
    strict_nulls: bool = False,
    no_posts_recency: float | None = 1.0,
) -> DataFrame:
    """Engagement total, rate, recency and frequency per profile (and per user name of its owner).

    One shuffle for the owner totals, one join. ``strict_nulls`` leaves profiles without posts null and
    divides by zero followers to infinity instead of the guarded defaults.
    """
    keyed = ["ownerId", "ownerUsername", "commentsCount", "likesCount", "data_hora"]
    totals = owner_totals(combined_posts(posts.select(*keyed), reels.select(*keyed)))
    return with_metrics(profiles, totals, run_id, generated_at, strict_nulls, no_posts_recency)


def with_metrics(
    profiles: DataFrame,
    totals: DataFrame,
    run_id: str | None = None,
    generated_at: datetime | None = None,
    strict_nulls: bool = False,
    no_posts_recency: float | None = 1.0,
) -> DataFrame:
    """The metrics of ``engagement`` from totals per owner, wherever these come from."""
    joined = profiles.join(totals, profiles["id"] == totals["ownerId"], "left").drop("ownerId")
    total = F.col("commentsSum") + F.col("likesSum")
    idle = F.lit(None).cast("double") if no_posts_recency is None else F.lit(float(no_posts_recency))
    since_last = whole_days(F.col("maxData"), latest_time(joined))
    active = whole_days(F.col("minData"), F.col("maxData"))
    recency = F.lit(1.0) / (since_last + 1)
    frequency = F.col("count") / (active + 1)
    if strict_nulls:
        metrics = {
            "TOTAL ENGAJAMENTO": total.cast("bigint"),
            "% ENGAJAMENTO": _strict_ratio(total, F.col("followersCount")),
            "RECENCIA": recency,
            "FREQUENCIA": frequency,
        }
    else:
        whole = F.coalesce(total, F.lit(0)).cast("bigint")
        # Adding zero turns a negative zero (0 over negative followers) into zero.
        metrics = {
            "TOTAL ENGAJAMENTO": whole,
            "% ENGAJAMENTO": ratio(whole, F.col("followersCount")) + F.lit(0.0),
            "RECENCIA": F.coalesce(recency, idle),
            "FREQUENCIA": F.coalesce(frequency, F.lit(0.0)),
            "commentsSum": F.coalesce("commentsSum", F.lit(0)),
            "likesSum": F.coalesce("likesSum", F.lit(0)),
            "count": F.coalesce("count", F.lit(0)),
        }
    out = joined.withColumns(metrics)
    if run_id is not None:
        out = out.withColumns(gold_lineage(run_id, generated_at))
    return out


def gold_lineage(run_id: str, generated_at: datetime | None = None) -> dict[str, Column]:
    """Run id and one literal time per run, so a replay writes the same rows."""
    stamp = generated_at or datetime.now(timezone.utc)
    return {"_run_id": F.lit(run_id), "_generated_at": F.lit(stamp).cast("timestamp")}


def sentiment_table(comments: DataFrame, run_id: str, generated_at: datetime | None = None) -> DataFrame:
    return conform(comments.withColumns(gold_lineage(run_id, generated_at)), GOLD_SENTIMENT)


def cluster_table(
    labelled: DataFrame,
    algorithm: str,
    score: float,
    run_id: str,
    key: str = "id",
    name: str = "username",
    label: str = "cluster",
    generated_at: datetime | None = None,
) -> DataFrame:
    """Labels travel with their rows, so no positional vector is needed."""
    table = labelled.select(
        quoted(key).cast("string").alias("id"),
        quoted(name).cast("string").alias("username"),
        quoted(label).cast("bigint").alias("cluster_label"),
        F.lit(algorithm).alias("cluster_algo"),
        F.lit(float(score)).alias("cluster_score"),
    )
    return conform(table.withColumns(gold_lineage(run_id, generated_at)), GOLD_CLUSTERS)


def topic_table(sizes: DataFrame, run_id: str, generated_at: datetime | None = None) -> DataFrame:
    return conform(sizes.withColumns(gold_lineage(run_id, generated_at)), GOLD_TOPICS)
