"""Structured Streaming over the driver tables, read as file streams and run until what is there is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from engagelake.catalog.registry import GOLD, JOINED, POSTS, PROFILES, TOTALS, query, rounded, scratch
from engagelake.config import LakeConfig
from engagelake.sources import adapters
from engagelake.sources.adapters import table
from engagelake.sources.lake import Lake
from engagelake.streaming.ingest import ingest_stream
from engagelake.streaming.running import current_totals, running_changes, running_gold, running_totals, summed_changes, write_changes


def stream_table(spark, folder: str, name: str):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query("streamed_bronze", """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS "ownerId", CAST(floor(value) AS BIGINT) AS "likesCount",
       event_type AS type FROM events""")
def _ingest(spark, folder):
    root = scratch(spark)
    lake = Lake(spark, LakeConfig(data_root=root))
    posts = stream_table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("ownerId"),
        F.floor("value").alias("likesCount"), F.col("event_type").alias("type"), F.array("props").alias("caption"),
    )
    ingest_stream(lake, "posts", posts, f"{root}/progress").awaitTermination()
    return lake.bronze("posts").select("id", "ownerId", "likesCount", "type")


@query("running_engagement", """
SELECT CAST(user_id AS VARCHAR) AS "ownerId", 'user' || CAST(user_id AS VARCHAR) AS "ownerUsername",
       CAST(sum(event_id % 100) AS BIGINT) AS "commentsSum", CAST(sum(floor(value)) AS BIGINT) AS "likesSum",
       min(ts) AS "minData", max(ts) AS "maxData", count(*) AS "count"
FROM events GROUP BY 1, 2""")
def _running(spark, folder):
    root = scratch(spark)
    user = F.col("user_id").cast("string")
    posts = stream_table(spark, folder, "events").select(
        F.col("event_id").alias("id"), user.alias("ownerId"), F.concat(F.lit("user"), user).alias("ownerUsername"),
        (F.col("event_id") % 100).alias("commentsCount"), F.floor("value").alias("likesCount"),
        F.col("ts").alias("data_hora"), F.col("ts").cast("timestamp").alias("event_time"),
    )
    # Every publication arrives twice, as from two overlapping scrapes.
    twice = posts.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    write_changes(running_totals(twice), f"{root}/changes", f"{root}/progress").awaitTermination()
    return current_totals(spark, f"{root}/changes")


@query("running_corrections", """
SELECT CAST(user_id AS VARCHAR) AS "ownerId", 'user' || CAST(user_id AS VARCHAR) AS "ownerUsername",
       CAST(sum(event_id % 100) AS BIGINT) AS "commentsSum", CAST(sum(floor(value) + event_id % 3) AS BIGINT) AS "likesSum",
       min(ts) AS "minData", max(ts) AS "maxData", count(*) AS "count", count(*) FILTER (event_id % 3 > 0) AS corrected
FROM events GROUP BY 1, 2""")
def _corrections(spark, folder):
    """Every publication is scraped twice; the second scrape corrects the likes of two in three."""
    root = scratch(spark)
    user = F.col("user_id").cast("string")
    posts = stream_table(spark, folder, "events").withColumn("again", F.explode(F.array(F.lit(1), F.lit(0)))).select(
        F.col("event_id").alias("id"), user.alias("ownerId"), F.concat(F.lit("user"), user).alias("ownerUsername"),
        (F.col("event_id") % 100).alias("commentsCount"), (F.floor("value") + F.col("again") * (F.col("event_id") % 3)).alias("likesCount"),
        F.col("ts").alias("data_hora"), (F.col("ts").cast("timestamp") + F.make_dt_interval(F.col("again"))).alias("scraped"))
    write_changes(running_changes(posts), f"{root}/changes", f"{root}/progress").awaitTermination()
    return summed_changes(spark, f"{root}/changes")


@query("streamed_two_sources", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type FROM events
UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders""")
def _two_sources(spark, folder):
    """Two streams with checkpoints of their own fill one Bronze table."""
    root = scratch(spark)
    lake = Lake(spark, LakeConfig(data_root=root))
    events = stream_table(spark, folder, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"))
    orders = stream_table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderstatus").alias("type"))
    for name, stream in (("events", events), ("orders", orders)):
        ingest_stream(lake, "posts", stream, f"{root}/progress-{name}").awaitTermination()
    return lake.bronze("posts").select("id", "type")


@query("running_gold", f"""
WITH {PROFILES}, {POSTS}, reels AS (SELECT * FROM posts WHERE false), {TOTALS}, {JOINED}, {GOLD}
SELECT id, username, "commentsSum", "likesSum", "count", "TOTAL ENGAJAMENTO", round("% ENGAJAMENTO", 6) + 0.0 AS "% ENGAJAMENTO",
       round("RECENCIA", 6) AS "RECENCIA", round("FREQUENCIA", 6) AS "FREQUENCIA" FROM gold""")
def _running_gold(spark, folder):
    """Gold metrics from a stream of orders, which come in no order of time."""
    root = scratch(spark)
    owner = F.col("o_custkey")
    posts = stream_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), owner.cast("string").alias("ownerId"), adapters.user_name("o_custkey").alias("ownerUsername"),
        (F.col("o_orderkey") % 100).alias("commentsCount"), F.floor("o_totalprice").alias("likesCount"),
        F.col("o_orderdate").alias("data_hora"))
    write_changes(running_totals(posts), f"{root}/changes", f"{root}/progress").awaitTermination()
    gold = running_gold(adapters.profiles(spark, folder), f"{root}/changes")
    return rounded(gold.select("id", "username", "commentsSum", "likesSum", "count", "TOTAL ENGAJAMENTO", "% ENGAJAMENTO", "RECENCIA", "FREQUENCIA"),
                   6, "% ENGAJAMENTO", "RECENCIA", "FREQUENCIA")
