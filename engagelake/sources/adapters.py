"""Domain tables from the driver's parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMENTS_PER_CAPTURE = 25


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file once."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def user_name(key: str) -> Column:
    return F.concat(F.lit("Customer#"), F.lpad(F.col(key).cast("string"), 9, "0"))


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as profiles, and suppliers as profiles without posts."""
    key = F.col("c_custkey")
    owners = table(spark, folder, "customer").select(
        key.cast("string").alias("id"),
        F.col("c_name").alias("username"),
        F.col("c_name").alias("fullName"),
        F.concat(F.lit("https://social.example/"), key.cast("string"), F.lit("/")).alias("inputUrl"),
        F.floor("c_acctbal").cast("int").alias("followersCount"),
        (key % 500).cast("int").alias("followsCount"),
        (key % 37).cast("int").alias("postsCount"),
        (key % 2 == 0).alias("verified"),
        (key % 7 == 3).alias("private"),
        (key % 3 == 0).alias("isBusinessAccount"),
        F.col("c_mktsegment").alias("businessCategoryName"),
        F.col("c_nationkey").alias("nation"),
    )
    key = F.col("s_suppkey")
    quiet = table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), key.cast("string")).alias("id"),
        F.col("s_name").alias("username"),
        F.col("s_name").alias("fullName"),
        F.concat(F.lit("https://social.example/s"), key.cast("string"), F.lit("/")).alias("inputUrl"),
        F.floor("s_acctbal").cast("int").alias("followersCount"),
        (key % 500).cast("int").alias("followsCount"),
        (key % 37).cast("int").alias("postsCount"),
        (key % 2 == 0).alias("verified"),
        (key % 7 == 3).alias("private"),
        (key % 3 == 0).alias("isBusinessAccount"),
        F.lit("SUPPLIER").alias("businessCategoryName"),
        F.col("s_nationkey").alias("nation"),
    )
    return owners.union(quiet)


def posts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as feed posts."""
    owner = F.col("o_custkey")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        owner.cast("string").alias("ownerId"),
        user_name("o_custkey").alias("ownerUsername"),
        (F.col("o_orderkey") % 100).alias("commentsCount"),
        F.floor("o_totalprice").alias("likesCount"),
        F.col("o_orderdate").alias("data_hora"),
        F.col("o_orderstatus").alias("type"),
        F.lit("FEED").alias("Tipo"),
        F.col("o_orderpriority").alias("caption"),
    )


def reels(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as short videos, owned through their order."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, folder, "lineitem")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.col("o_custkey").cast("string").alias("ownerId"),
        user_name("o_custkey").alias("ownerUsername"),
        F.col("l_linenumber").cast("bigint").alias("commentsCount"),
        F.floor("l_quantity").alias("likesCount"),
        F.floor("l_extendedprice").alias("videoPlayCount"),
        F.col("l_quantity").alias("videoDuration"),
        F.col("l_shipdate").alias("data_hora"),
        F.col("l_returnflag").alias("type"),
        F.lit("REELS").alias("Tipo"),
    )


def plays(spark: SparkSession, folder: str) -> DataFrame:
    """All line items with the numeric columns used for statistics; no join."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_linenumber").cast("bigint").alias("commentsCount"),
        F.floor("l_quantity").alias("likesCount"),
        F.floor("l_extendedprice").alias("videoPlayCount"),
        (F.col("l_discount") * 100 + F.col("l_tax")).alias("videoDuration"),
        F.col("l_returnflag").alias("type"),
        F.col("l_shipdate").alias("data_hora"),
        F.col("l_partkey").alias("part"),
    )


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as raw short videos with nested comments.

    A capture holds at most 25 turns, like a scrape that returns the latest comments, so no list grows with
    the length of a conversation.
    """
    comment = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("text"),
        F.col("role").alias("ownerUsername"),
        (F.col("turn") * 3).alias("likesCount"),
        (F.col("turn") % 4).alias("repliesCount"),
        F.struct(F.col("role").alias("id"), (F.col("role") == "assistant").alias("is_verified"),
                 F.lower("role").alias("username")).alias("owner"),
    )
    capture = F.floor(F.col("turn") / COMMENTS_PER_CAPTURE)
    return (
        table(spark, folder, "conversations")
        .groupBy("conv_id", capture.alias("capture"))
        .agg(F.to_json(F.collect_list(comment)).alias("latestComments"))
        .select(
            F.col("conv_id").cast("string").alias("id"),
            F.concat(F.lit("https://social.example/"), F.col("conv_id") % 10).alias("inputUrl"),
            F.concat(F.lit("run-"), F.col("capture")).alias("_run_id"),
            "latestComments",
        )
    )


def scored_comments(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as comments with a sentiment label from their labels and a topic from their language."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels")
    sentiment = (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .when(F.col("quality") == 0, "neutral")
    )
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id_comment"),
        (F.col("doc_id") % 100).cast("string").alias("id_reel"),
        "text",
        F.concat(F.lit("https://social.example/"), F.expr("substring(source, 4)")).alias("inputUrl"),
        F.col("source"),
        F.col("lang"),
        sentiment.alias("sentiment_label"),
        (F.col("doc_id") % 5).alias("repliesCount"),
        F.length("text").cast("bigint").alias("likesCount"),
    )
