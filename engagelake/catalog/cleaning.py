"""Casts, dates, strings, JSON and the Silver cleaners."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from engagelake.catalog.registry import as_double, query
from engagelake.functions.casts import lenient_bool, lenient_int, lenient_long, pinned_flag, round_even
from engagelake.functions.dates import WEEKDAYS_PT, local_time, weekday_index, weekday_name, whole_days
from engagelake.functions.nested import decode_list, infer_element
from engagelake.functions.text import merge_missing_prefix, strip_slash, text_length
from engagelake.operators.silver import (
    clean_comments,
    clean_posts,
    clean_profiles,
    clean_reels,
    comments_view,
    explode_comments,
    keep_latest,
)
from engagelake.schemas import SILVER_POSTS, conform, encode_nested
from engagelake.sources.adapters import captures, table

_PROPS = T.StructType([T.StructField("k", T.LongType())])

# Raw text numbers in the shapes a scrape delivers.
_RAW_NUMBER = """CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS {text}) WHEN 1 THEN CAST(c_custkey AS {text}) || '.7'
  WHEN 2 THEN 'n/a' WHEN 3 THEN NULL WHEN 4 THEN ' ' || CAST(c_custkey AS {text}) || ' ' ELSE '3e9' END"""
_RAW_FLAG = "CASE c_custkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN NULL ELSE '{other}' END"


@query("lenient_casts", f"""
WITH raw AS (SELECT c_custkey, {_RAW_NUMBER.format(text='VARCHAR')} AS n, {_RAW_FLAG.format(other='maybe')} AS b,
                    {_RAW_FLAG.format(other='1')} AS p FROM customer),
num AS (SELECT *, trunc(try_cast(trim(n) AS DOUBLE)) AS d FROM raw)
SELECT c_custkey, CAST(coalesce(CASE WHEN abs(d) < 2147483648 THEN d END, 0) AS INTEGER) AS as_int,
       CAST(coalesce(d, 0) AS BIGINT) AS as_long, coalesce(b = 'true', false) AS as_bool,
       coalesce(p IN ('true', '1'), false) AS pinned
FROM num""")
def _casts(spark, folder):
    raw = table(spark, folder, "customer").select(
        "c_custkey",
        F.expr(_RAW_NUMBER.format(text="STRING")).alias("n"),
        F.expr(_RAW_FLAG.format(other="maybe")).alias("b"),
        F.expr(_RAW_FLAG.format(other="1")).alias("p"),
    )
    return raw.select(
        "c_custkey", lenient_int(F.col("n")).alias("as_int"), lenient_long(F.col("n")).alias("as_long"),
        lenient_bool(F.col("b")).alias("as_bool"), pinned_flag(F.col("p")).alias("pinned"),
    )


@query("half_even_rounding", """
SELECT event_id, round_even(CAST(floor(value * 8) AS DOUBLE) / 8, 2) AS rounded FROM events""")
def _half_even(spark, folder):
    eighths = F.floor(F.col("value") * 8).cast("double") / 8
    return table(spark, folder, "events").select("event_id", round_even(eighths).alias("rounded"))


@query("local_times", """
SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS local_time FROM events
UNION ALL
SELECT -1 - o_orderkey, (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' FROM orders""")
def _local_times(spark, folder):
    def iso(c: str):
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))

    events = table(spark, folder, "events").select("event_id", iso("ts").alias("text"))
    orders = table(spark, folder, "orders").select((-1 - F.col("o_orderkey")).alias("event_id"), iso("o_orderdate").alias("text"))
    return events.union(orders).select("event_id", local_time(F.col("text")).alias("local_time"))


@query("whole_days_between", """
SELECT event_id, CAST(datesub('day', ts, TIMESTAMP '2024-02-01 12:00:00') AS BIGINT) AS days FROM events""")
def _whole_days(spark, folder):
    end = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    return table(spark, folder, "events").select("event_id", whole_days(F.col("ts"), end).alias("days"))


_DAYS = "[" + ", ".join(f"'{d}'" for d in WEEKDAYS_PT) + "]"


@query("weekday_names", f"""
SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, {_DAYS}[isodow(ts)] AS dia FROM events""")
def _weekdays(spark, folder):
    ts = F.col("ts")
    return table(spark, folder, "events").select("event_id", weekday_index(ts).alias("weekday"), weekday_name(ts).alias("dia"))


@query("strip_slashes", """
SELECT page_id, regexp_replace(CASE WHEN page_id % 2 = 0 THEN url || '/' ELSE url END, '/$', '') AS link FROM pages""")
def _strip(spark, folder):
    link = F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("/"))).otherwise(F.col("url"))
    return table(spark, folder, "pages").select("page_id", strip_slash(link).alias("link"))


@query("text_lengths", """SELECT doc_id, CAST(length(text) AS BIGINT) AS n FROM documents""")
def _lengths(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text_length(F.col("text")).alias("n"))


@query("merged_categories", """
WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'None,' || c_mktsegment ELSE c_mktsegment END AS category FROM customer)
SELECT regexp_replace(category, '^None,', '') AS category, count(*) AS "count" FROM c GROUP BY 1""")
def _merged(spark, folder):
    category = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("None,"), "c_mktsegment")).otherwise(F.col("c_mktsegment"))
    raw = table(spark, folder, "customer").select(merge_missing_prefix(category).alias("category"))
    return raw.groupBy("category").agg(F.count(F.lit(1)).alias("count"))


@query("decode_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def _decode(spark, folder):
    listed = F.concat(F.lit("["), F.col("props"), F.lit("]"))
    item = F.explode(decode_list(listed, _PROPS)).alias("e")
    return table(spark, folder, "events").select("event_id", item).select("event_id", "e.k")


@query("encode_json", """
SELECT event_id, '{"type":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}' AS body,
       '["' || event_type || '"]' AS tags FROM events""")
def _encode(spark, folder):
    nested = table(spark, folder, "events").select(
        "event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")).alias("body"),
        F.array("event_type").alias("tags"),
    )
    return encode_nested(nested)


@query("drop_noise", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS username, 'bronze' AS _source_layer, c_name AS "fullName" FROM customer""")
def _noise(spark, folder):
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("username"),
        F.col("c_mktsegment").alias("biography"), F.col("c_acctbal").alias("fbid"), F.lit("x").alias("url"),
    )
    return clean_profiles(raw)


@query("keep_latest", """
SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def _latest(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "ts", "event_type")
    return keep_latest(events, ["user_id"], "ts")


@query("clean_profiles", """
WITH newest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events)
SELECT CAST(user_id AS VARCHAR) AS id, 'user' || CAST(user_id AS VARCHAR) AS username,
       CAST(trunc(value) AS INTEGER) AS "followersCount", CAST(0 AS INTEGER) AS "postsCount",
       event_type = 'purchase' AS verified, false AS private, strftime(ts, '%Y-%m-%d') AS _run_id,
       'user' || CAST(user_id AS VARCHAR) AS "fullName", 'bronze' AS _source_layer
FROM newest WHERE r = 1""")
def _clean_profiles(spark, folder):
    user = F.col("user_id").cast("string")
    raw = table(spark, folder, "events").select(
        user.alias("id"), F.concat(F.lit("user"), user).alias("username"),
        F.col("value").cast("string").alias("followersCount"), F.col("event_type").alias("postsCount"),
        F.when(F.col("event_type") == "purchase", "true").alias("verified"), F.lit(None).cast("boolean").alias("private"),
        F.lit("noise").alias("biography"),
        F.col("ts").alias("_ingested_at"), F.date_format("ts", "yyyy-MM-dd").alias("_run_id"),
    )
    return clean_profiles(raw).drop("_ingested_at")


def _iso(c: str):
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


@query("clean_posts", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS "ownerId",
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE trunc(o_totalprice) END AS BIGINT) AS "likesCount",
       o_orderkey % 100 AS "commentsCount",
       (o_orderdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS data_hora,
       'FEED' AS "Tipo", 'bronze' AS _source_layer
FROM orders""")
def _clean_posts(spark, folder):
    likes = F.when(F.col("o_orderkey") % 3 == 0, F.lit("hidden")).otherwise(F.col("o_totalprice").cast("string"))
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("ownerId"),
        likes.alias("likesCount"), (F.col("o_orderkey") % 100).cast("string").alias("commentsCount"),
        _iso("o_orderdate").alias("timestamp"), F.lit("[]").alias("hashtags"),
    )
    return clean_posts(raw).drop("timestamp")


@query("clean_reels", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_linenumber AS BIGINT) AS "commentsCount",
       CAST(CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE floor(l_quantity) END AS BIGINT) AS "likesCount",
       CAST(l_linenumber + CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE floor(l_quantity) END AS BIGINT) AS "Total de Engajamento",
       l_partkey % 2 = 0 AS "isPinned",
       (l_shipdate AT TIME ZONE 'UTC') AT TIME ZONE 'America/Sao_Paulo' AS data_hora,
       'REELS' AS "Tipo", 'bronze' AS _source_layer
FROM lineitem""")
def _clean_reels(spark, folder):
    raw = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_linenumber").cast("bigint").alias("commentsCount"),
        F.when(F.col("l_partkey") % 5 != 0, F.floor("l_quantity")).alias("likesCount"),
        F.when(F.col("l_partkey") % 2 == 0, "YES").when(F.col("l_partkey") % 3 == 0, "0").alias("isPinned"),
        _iso("l_shipdate").alias("timestamp"),
    )
    return clean_reels(raw).drop("timestamp")


@query("clean_comments", """
SELECT CAST(conv_id AS VARCHAR) AS id_reel, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id_comment, text,
       CAST(length(text) AS BIGINT) AS "comprimento texto", role AS "ownerUsername", turn * 3 AS "likesCount",
       turn % 4 AS "repliesCount", CAST(NULL AS VARCHAR) AS "timestamp",
       'https://social.example/' || CAST(conv_id % 10 AS VARCHAR) AS "inputUrl",
       'run-' || CAST(turn // 25 AS VARCHAR) AS _run_id, 'bronze' AS _source_layer
FROM conversations WHERE length(text) < 512""")
def _clean_comments(spark, folder):
    return clean_comments(captures(spark, folder))


@query("comments_wide", """
SELECT CAST(conv_id AS VARCHAR) AS id_reel, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id_comment,
       role AS "owner.id", role = 'assistant' AS "owner.is_verified", lower(role) AS "owner.username",
       CAST(length(text) AS BIGINT) AS "comprimento texto"
FROM conversations WHERE length(text) < 512""")
def _wide(spark, folder):
    wide = comments_view(captures(spark, folder))
    return wide.select("id_reel", "id_comment", "`owner.id`", "`owner.is_verified`", "`owner.username`", "`comprimento texto`")


@query("inferred_comments", """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text,
       CASE WHEN conv_id % 50 = 49 THEN CAST(turn AS DOUBLE) END AS late FROM conversations""")
def _inferred(spark, folder):
    """Comments whose fields are found by reading all texts; one field comes late and seldom."""
    comment = F.struct(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text"), F.when(F.col("conv_id") % 50 == 49, F.col("turn")).alias("late"))
    raw = table(spark, folder, "conversations").select(F.to_json(F.array(comment)).alias("latestComments"))
    rows = explode_comments(raw, infer_element(raw, "latestComments"))
    return as_double(rows.select("comment.id", "comment.text", "comment.late"), "late")


@query("distinct_rows", """SELECT DISTINCT role, conv_id % 10 AS entity, turn FROM conversations""")
def _distinct(spark, folder):
    return table(spark, folder, "conversations").select(
        "role", (F.col("conv_id") % 10).alias("entity"), "turn"
    ).dropDuplicates()


@query("conform_contract", """
SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS "ownerId", event_type AS "ownerUsername",
       CAST(NULL AS VARCHAR) AS "inputUrl", event_type AS type, CAST(floor(value) AS BIGINT) AS "commentsCount",
       user_id AS "likesCount", ts AS data_hora, 'FEED' AS "Tipo", CAST(NULL AS VARCHAR) AS "shortCode", props AS caption,
       CAST(NULL AS DOUBLE) AS "videoPlayCount", CAST(NULL AS DOUBLE) AS "videoDuration",
       strftime(ts, '%Y-%m-%d') AS _run_id, 'bronze' AS _source_layer
FROM events""")
def _conform(spark, folder):
    events = table(spark, folder, "events").select(
        F.lit("dropped").alias("extra"), F.col("event_id").alias("id"), F.col("user_id").alias("ownerId"),
        F.col("event_type").alias("ownerUsername"), F.col("event_type").alias("type"),
        F.floor("value").cast("int").alias("commentsCount"), F.col("user_id").cast("int").alias("likesCount"),
        F.col("ts").alias("data_hora"), F.lit("FEED").alias("Tipo"), F.col("props").alias("caption"),
        F.col("ts").alias("_ingested_at"), F.date_format("ts", "yyyy-MM-dd").alias("_run_id"),
        F.lit("bronze").alias("_source_layer"),
    )
    return as_double(conform(events, SILVER_POSTS).drop("_ingested_at"), "videoPlayCount")
