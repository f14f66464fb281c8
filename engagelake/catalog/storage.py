"""Bronze runs, as-of reads, the lake facade and the jobs, on tables written from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from engagelake.catalog.registry import GOLD, JOINED, PROFILES, TOTALS, query, rounded, scratch
from engagelake.config import LakeConfig
from engagelake.plans import jobs
from engagelake.sources.adapters import captures, profiles, table, user_name
from engagelake.sources.files import load_table, save_tables
from engagelake.sources.lake import Lake


def daily(spark, folder) -> Lake:
    """A lake whose posts are the events, in daily runs that were adopted with their lineage."""
    lake = _lake(spark)
    events = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("ownerId"), F.col("event_type").alias("type"),
        F.col("ts").cast("timestamp").alias("_ingested_at"), F.date_format("ts", "yyyy-MM-dd").alias("_run_id"))
    lake.adopt("posts", events)
    return lake


def _events(rows):
    return rows.select(F.col("id").cast("bigint").alias("event_id"), F.col("ownerId").cast("bigint").alias("user_id"), "_run_id")


@query("as_of_version", """
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS _run_id FROM events
WHERE strftime(ts, '%Y-%m-%d') IN (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS d FROM events ORDER BY d LIMIT 10)""")
def _version(spark, folder):
    return _events(daily(spark, folder).bronze_at("posts", version=9))


@query("as_of_timestamp", """
SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '2024-01-15 06:00:00'""")
def _timestamp(spark, folder):
    return _events(daily(spark, folder).bronze_at("posts", timestamp="2024-01-15 06:00:00")).drop("_run_id")


@query("run_history", """
SELECT strftime(ts, '%Y-%m-%d') AS _run_id, min(ts) AS first_ingested_at, max(ts) AS last_ingested_at, count(*) AS "rows",
       row_number() OVER (ORDER BY min(ts)) - 1 AS version
FROM events GROUP BY 1""")
def _history(spark, folder):
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_ingested_at", "last_ingested_at")]
    return daily(spark, folder).history("posts").select("_run_id", *times, "rows", "version")


def _lake(spark) -> Lake:
    return Lake(spark, LakeConfig(data_root=scratch(spark)))


@query("bronze_all_runs", """
SELECT run AS _run_id, count(*) AS "rows", count(DISTINCT c_custkey) AS ids, CAST(sum(floor(c_acctbal)) AS BIGINT) AS followers
FROM customer, (SELECT 'r1' AS run UNION ALL SELECT 'r2') WHERE run = 'r1' OR c_custkey % 2 = 0 GROUP BY 1""")
def _all_runs(spark, folder):
    lake = _lake(spark)
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username"),
        F.floor("c_acctbal").alias("followersCount"), F.col("c_mktsegment").alias("businessCategoryName"),
    )
    lake.append("profiles", raw, "r1")
    lake.append("profiles", raw.where(F.col("id").cast("bigint") % 2 == 0), "r2")
    return lake.bronze("profiles").groupBy("_run_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.sum("followersCount").alias("followers")
    )


@query("comments_facade", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id_comment, CAST(length(text) AS BIGINT) AS "comprimento texto"
FROM conversations WHERE length(text) < 512""")
def _facade(spark, folder):
    lake = _lake(spark)
    lake.append("reels", captures(spark, folder).drop("_run_id"), "r1")
    from engagelake.operators.silver import clean_comments

    lake.replace("silver", "comments", clean_comments(lake.bronze("reels")))
    # No scored comments yet, so the facade falls back to the clean ones.
    return lake.load("comments").select("id_comment", "`comprimento texto`")


@query("saved_tables", """
SELECT 'nation' AS name, count(*) AS "rows" FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier""")
def _saved(spark, folder):
    root = scratch(spark)
    save_tables({n: table(spark, folder, n) for n in ("nation", "supplier")}, root)
    parts = [
        load_table(spark, root, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows")
        for n in ("nation", "supplier")
    ]
    return parts[0].union(parts[1])


_ALL_POSTS = """
posts AS (SELECT CAST(o_custkey AS VARCHAR) AS "ownerId", printf('Customer#%09d', o_custkey) AS "ownerUsername",
                 o_orderkey % 100 AS "commentsCount", CAST(floor(o_totalprice) AS BIGINT) AS "likesCount",
                 (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS data_hora FROM orders),
reels AS (SELECT CAST(l_suppkey AS VARCHAR) AS "ownerId", printf('Customer#%09d', l_suppkey) AS "ownerUsername",
                 CAST(l_linenumber AS BIGINT) AS "commentsCount", CAST(floor(l_quantity) AS BIGINT) AS "likesCount",
                 (l_shipdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS data_hora FROM lineitem)"""


@query("bronze_to_gold", f"""
WITH {PROFILES}, {_ALL_POSTS}, {TOTALS}, {JOINED}, {GOLD}
SELECT id, username, "followersCount", "TOTAL ENGAJAMENTO", round("% ENGAJAMENTO", 6) + 0.0 AS "% ENGAJAMENTO",
       round("RECENCIA", 6) AS "RECENCIA", round("FREQUENCIA", 6) AS "FREQUENCIA", "count", "minData", "maxData" FROM gold""")
def _bronze_to_gold(spark, folder):
    lake = _lake(spark)

    def iso(c: str):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))

    def owner(c: str):
        return F.col(c).cast("string").alias("ownerId"), user_name(c).alias("ownerUsername")

    tables = {
        "profiles": profiles(spark, folder).select("id", "username", "followersCount", "businessCategoryName"),
        "posts": table(spark, folder, "orders").select(
            F.col("o_orderkey").cast("string").alias("id"), *owner("o_custkey"),
            (F.col("o_orderkey") % 100).alias("commentsCount"), F.floor("o_totalprice").alias("likesCount"),
            iso("o_orderdate").alias("timestamp"),
        ),
        "reels": table(spark, folder, "lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), *owner("l_suppkey"),
            F.col("l_linenumber").alias("commentsCount"), F.floor("l_quantity").alias("likesCount"),
            iso("l_shipdate").alias("timestamp"), F.lit("[]").alias("latestComments"),
        ),
    }
    run_id = jobs.bronze(lake, tables)["run_id"]
    jobs.silver(lake, run_id)
    jobs.gold(lake, run_id)
    metrics = ["% ENGAJAMENTO", "RECENCIA", "FREQUENCIA"]
    columns = ["id", "username", "followersCount", "TOTAL ENGAJAMENTO", *metrics, "count", "minData", "maxData"]
    return rounded(lake.load("profiles").select(*[f"`{c}`" for c in columns]), 6, *metrics)
