"""The registry and the pieces the queries share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engagelake.schemas import quoted
from engagelake.session import configure, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, folder) -> DataFrame`` with its SQL twin."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder.rstrip("/"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round for comparison: engines add doubles in different orders. Adding zero drops the sign of zero."""
    return df.withColumns({c: F.round(quoted(c), digits) + F.lit(0.0) for c in columns})


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    """Whole-number columns that hold nulls, as doubles, so both engines hand them over in one form."""
    return df.withColumns({c: quoted(c).cast("double") for c in columns})


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


# SQL for the domain tables of engagelake.sources.adapters.
PROFILES = """
profiles AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS username, c_name AS "fullName",
         'https://social.example/' || CAST(c_custkey AS VARCHAR) || '/' AS "inputUrl",
         CAST(floor(c_acctbal) AS INTEGER) AS "followersCount",
         CAST(c_custkey % 500 AS INTEGER) AS "followsCount",
         CAST(c_custkey % 37 AS INTEGER) AS "postsCount",
         c_custkey % 2 = 0 AS verified, c_custkey % 7 = 3 AS private, c_custkey % 3 = 0 AS "isBusinessAccount",
         c_mktsegment AS "businessCategoryName", c_nationkey AS nation
  FROM customer
  UNION ALL
  SELECT 's' || CAST(s_suppkey AS VARCHAR), s_name, s_name, 'https://social.example/s' || CAST(s_suppkey AS VARCHAR) || '/',
         CAST(floor(s_acctbal) AS INTEGER), CAST(s_suppkey % 500 AS INTEGER), CAST(s_suppkey % 37 AS INTEGER),
         s_suppkey % 2 = 0, s_suppkey % 7 = 3, s_suppkey % 3 = 0, 'SUPPLIER', s_nationkey
  FROM supplier)"""
POSTS = """
posts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS "ownerId",
         printf('Customer#%09d', o_custkey) AS "ownerUsername", o_orderkey % 100 AS "commentsCount",
         CAST(floor(o_totalprice) AS BIGINT) AS "likesCount", o_orderdate AS data_hora,
         o_orderstatus AS type, 'FEED' AS "Tipo"
  FROM orders)"""
REELS = """
reels AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS id,
         CAST(o_custkey AS VARCHAR) AS "ownerId", printf('Customer#%09d', o_custkey) AS "ownerUsername",
         CAST(l_linenumber AS BIGINT) AS "commentsCount", CAST(floor(l_quantity) AS BIGINT) AS "likesCount",
         CAST(floor(l_extendedprice) AS BIGINT) AS "videoPlayCount", l_quantity AS "videoDuration",
         l_shipdate AS data_hora, l_returnflag AS type, 'REELS' AS "Tipo"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PLAYS = """
plays AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_linenumber AS BIGINT) AS "commentsCount",
         CAST(floor(l_quantity) AS BIGINT) AS "likesCount", CAST(floor(l_extendedprice) AS BIGINT) AS "videoPlayCount",
         l_discount * 100 + l_tax AS "videoDuration", l_returnflag AS type, l_shipdate AS data_hora, l_partkey AS part
  FROM lineitem)"""
TOTALS = """
totals AS (
  SELECT "ownerId", "ownerUsername", CAST(sum("commentsCount") AS BIGINT) AS "commentsSum",
         CAST(sum("likesCount") AS BIGINT) AS "likesSum", min(data_hora) AS "minData", max(data_hora) AS "maxData",
         count(*) AS "count"
  FROM (SELECT "ownerId", "ownerUsername", "commentsCount", "likesCount", data_hora FROM posts
        UNION ALL SELECT "ownerId", "ownerUsername", "commentsCount", "likesCount", data_hora FROM reels)
  GROUP BY 1, 2)"""
JOINED = """
joined AS (
  SELECT p.*, t."ownerUsername", t."commentsSum", t."likesSum", t."minData", t."maxData", t."count"
  FROM profiles p LEFT JOIN totals t ON p.id = t."ownerId")"""
GOLD = """
gold AS (
  SELECT id, username, "fullName", "inputUrl", "followersCount", "followsCount", "postsCount", "ownerUsername",
         coalesce("commentsSum", 0) AS "commentsSum", coalesce("likesSum", 0) AS "likesSum",
         coalesce("count", 0) AS "count", "minData", "maxData",
         coalesce("commentsSum" + "likesSum", 0) AS "TOTAL ENGAJAMENTO",
         coalesce(coalesce("commentsSum" + "likesSum", 0) / nullif("followersCount", 0), 0.0) + 0.0 AS "% ENGAJAMENTO",
         coalesce(1.0 / (datesub('day', "maxData", (SELECT max("maxData") FROM joined)) + 1), 1.0) AS "RECENCIA",
         coalesce("count" / (datesub('day', "minData", "maxData") + 1), 0.0) AS "FREQUENCIA"
  FROM joined)"""
SCORED = """
scored AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS id_comment, CAST(d.doc_id % 100 AS VARCHAR) AS id_reel, d.text,
         'https://social.example/' || substr(d.source, 4) AS "inputUrl", d.source, d.lang,
         CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' WHEN l.quality = 0 THEN 'neutral' END
           AS sentiment_label,
         d.doc_id % 5 AS "repliesCount", CAST(length(d.text) AS BIGINT) AS "likesCount"
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
ALL_GOLD = ",".join([PROFILES, POSTS, REELS, TOTALS, JOINED, GOLD])
