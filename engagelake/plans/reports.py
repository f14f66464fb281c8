"""Dashboard queries over the Gold and Silver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engagelake.functions.casts import round_even
from engagelake.operators.correlation import correlation_matrix
from engagelake.operators.distribution import two_series
from engagelake.operators.frequency import top_n
from engagelake.operators.silver import with_engagement_total
from engagelake.schemas import column_or, first_present, numeric_columns, present_columns, quoted


def kpis(profiles: DataFrame) -> DataFrame:
    """Six means over profiles; the per-publication ones are means of each profile's own ratio."""
    count = F.nullif(column_or(profiles, "count", 1), F.lit(0))

    def mean(value) -> F.Column:
        return round_even(F.avg(value.cast("double")), 2)

    return profiles.agg(
        mean(quoted("followersCount")).alias("mean_followers"),
        mean(column_or(profiles, "followsCount", None)).alias("mean_follows"),
        mean(column_or(profiles, "postsCount", None)).alias("mean_posts"),
        mean(column_or(profiles, "commentsSum", 0) / count).alias("comments_per_post"),
        mean(column_or(profiles, "likesSum", 0) / count).alias("likes_per_post"),
        mean(column_or(profiles, "% ENGAJAMENTO", None)).alias("mean_engagement"),
    )


def interactions(profiles: DataFrame) -> DataFrame:
    """Likes and comments beside their sum per profile, largest first."""
    total = quoted("likesSum") + quoted("commentsSum")
    return profiles.select("username", "likesSum", "commentsSum", total.alias("interactions")).orderBy(
        F.desc_nulls_last("interactions"), "username"
    )


def scatter(df: DataFrame, x: str, y: str, limit: int | None = None, seed: int = 42) -> DataFrame:
    """(x, y) pairs; with a limit, a repeatable sample of them for drawing."""
    pairs = df.select(quoted(x), quoted(y))
    return pairs if limit is None else pairs.orderBy(F.xxhash64(F.lit(seed), quoted(x), quoted(y))).limit(limit)


def exploratory(profiles: DataFrame, method: str = "pearson") -> dict[str, DataFrame]:
    """All tables of the exploratory page."""
    return {
        "kpis": kpis(profiles),
        "top_frequency": top_n(profiles, "FREQUENCIA", "username"),
        "top_engagement": top_n(profiles, "% ENGAJAMENTO", "username"),
        "followers": two_series(profiles, "username", "followersCount", "% ENGAJAMENTO"),
        "follows": two_series(profiles, "username", "followsCount", "% ENGAJAMENTO"),
        "posts": two_series(profiles, "username", "postsCount", "% ENGAJAMENTO"),
        "correlation": correlation_matrix(profiles, numeric_columns(profiles), method),
    }


def entities(comments: DataFrame, column: str = "inputUrl") -> DataFrame:
    """The values of the entity selector."""
    return comments.where(quoted(column).isNotNull()).select(quoted(column)).distinct()


def entity_counters(comments: DataFrame, entity: str) -> DataFrame:
    """Distinct reels and comments, replies and likes of one entity."""
    likes = first_present(comments, ["likesCount_comment", "likesCount"])
    return comments.where(quoted("inputUrl") == F.lit(entity)).agg(
        F.countDistinct("id_reel").alias("reels"),
        F.countDistinct("id_comment").alias("comments"),
        F.coalesce(F.sum("repliesCount"), F.lit(0)).alias("replies"),
        F.coalesce(F.sum(quoted(likes)), F.lit(0)).alias("likes"),
    )


def top_reels(reels: DataFrame, entity: str | None = None, n: int = 10) -> DataFrame:
    """The n reels with the most engagement, of one entity or of all."""
    df = reels if entity is None else reels.where(quoted("inputUrl") == F.lit(entity))
    df = with_engagement_total(df).withColumn("shortCode", column_or(df, "shortCode", None).cast("string"))
    key = first_present(df, ["id", "shortCode"])
    return top_n(df, "Total de Engajamento", key, n).select(
        *[quoted(c) for c in present_columns(df, ["id", "shortCode", "Total de Engajamento"])]
    )


def comment_listing(comments: DataFrame, entity: str) -> DataFrame:
    """The comment columns that exist, for one entity."""
    wanted = ["timestamp_comment", "timestamp", "owner.username", "ownerUsername", "text", "repliesCount",
              "likesCount_comment", "likesCount"]
    kept = present_columns(comments, wanted)
    return comments.where(quoted("inputUrl") == F.lit(entity)).select(*[quoted(c) for c in kept])


def entity_title(comments: DataFrame, entity: str, key: str = "id_comment") -> DataFrame:
    """One row with the display name of the entity."""
    column = first_present(comments, ["ownerFullName", "owner.username", "ownerUsername"])
    name = quoted(column) if column else F.lit(None).cast("string")
    return (
        comments.where(quoted("inputUrl") == F.lit(entity)).orderBy(quoted(key)).limit(1).select(name.alias("title"))
    )


def modelling(comments: DataFrame, reels: DataFrame, entity: str) -> dict[str, DataFrame]:
    """All tables of the modelling page for one entity."""
    return {
        "counters": entity_counters(comments, entity),
        "top_reels": top_reels(reels, entity),
        "title": entity_title(comments, entity),
        "comments": comment_listing(comments, entity),
    }
