"""Filters, joins, counts, pivots and shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from engagelake.catalog.registry import ALL_GOLD, POSTS, PROFILES, SCORED, as_double, query
from engagelake.functions.text import strip_slash
from engagelake.operators.describe import column_profile
from engagelake.operators.distribution import zscore_filter
from engagelake.operators.frequency import group_sizes, pivot_sizes, shares, value_counts, weekday_table
from engagelake.operators.sentiment import sentiment_by, top_by_class
from engagelake.plans import reports
from engagelake.schemas import boolean_columns
from engagelake.sources.adapters import plays, posts, profiles, scored_comments, table
from engagelake.sources.files import seed_links

ENTITY = "https://social.example/3"


@query("seed_links", """SELECT DISTINCT source AS "Link" FROM documents""")
def _seeds(spark, folder):
    padded = F.concat(F.lit("  "), F.col("source"), F.when(F.col("doc_id") % 2 == 0, " ").otherwise(""))
    return seed_links(table(spark, folder, "documents").select(padded.alias(" Link ")), "Link")


@query("entity_filter", f"""WITH {SCORED} SELECT id_comment, id_reel, lang FROM scored WHERE "inputUrl" = '{ENTITY}'""")
def _entity(spark, folder):
    comments = scored_comments(spark, folder).where(F.col("inputUrl") == ENTITY)
    return comments.select("id_comment", "id_reel", "lang")


@query("short_texts", """
SELECT doc_id, CAST(length(text) AS BIGINT) AS "comprimento texto" FROM documents WHERE length(text) < 512""")
def _short(spark, folder):
    docs = table(spark, folder, "documents").withColumn("comprimento texto", F.length("text").cast("bigint"))
    return docs.where(F.col("`comprimento texto`") < 512).select("doc_id", "`comprimento texto`")


@query("zscore_filter", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice) AS p,
                  CASE WHEN l_partkey % 50 = 0 THEN floor(l_quantity) * 20 ELSE floor(l_quantity) END AS q FROM lineitem),
m AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(q) AS mq, stddev_pop(q) AS sq FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(p AS BIGINT) AS plays, CAST(q AS BIGINT) AS likes FROM v, m
WHERE abs((p - mp) / sp) < 3 AND abs((q - mq) / sq) < 3""")
def _zscores(spark, folder):
    likes = F.floor("l_quantity")
    items = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").alias("plays"),
        F.when(F.col("l_partkey") % 50 == 0, likes * 20).otherwise(likes).alias("likes"),
    )
    return zscore_filter(items, ["plays", "likes"])


@query("threshold_filter", """
SELECT p_partkey, p_size % 4 AS cluster, p_retailprice FROM part WHERE p_retailprice > 950 AND p_size % 4 = 0""")
def _threshold(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", (F.col("p_size") % 4).alias("cluster"), "p_retailprice")
    return parts.where((F.col("p_retailprice") > 950) & (F.col("cluster") == 0))


@query("comments_with_reel_cluster", """
WITH reel AS (SELECT p_partkey AS id, p_size % 4 AS cluster FROM part)
SELECT CAST(d.doc_id AS VARCHAR) AS id_comment, CAST(r.cluster AS DOUBLE) AS cluster
FROM documents d LEFT JOIN reel r ON d.doc_id % 3000 = r.id""")
def _reel_cluster(spark, folder):
    reels = table(spark, folder, "part").select("p_partkey", (F.col("p_size") % 4).cast("double").alias("cluster"))
    comments = table(spark, folder, "documents").select("doc_id", (F.col("doc_id") % 3000).alias("id_reel"))
    joined = comments.join(reels, comments["id_reel"] == reels["p_partkey"], "left")
    return joined.select(F.col("doc_id").cast("string").alias("id_comment"), "cluster")


@query("comments_with_profile", f"""
WITH {PROFILES}, {SCORED}
SELECT s.id_comment, p."fullName" FROM scored s
LEFT JOIN profiles p ON s."inputUrl" = regexp_replace(p."inputUrl", '/$', '')""")
def _comment_profile(spark, folder):
    people = profiles(spark, folder).select(strip_slash(F.col("inputUrl")).alias("inputUrl"), "fullName")
    return scored_comments(spark, folder).join(people, "inputUrl", "left").select("id_comment", "fullName")


@query("flag_combinations", f"""
WITH {PROFILES} SELECT verified, private, "isBusinessAccount", count(*) AS "count" FROM profiles GROUP BY 1, 2, 3""")
def _flags(spark, folder):
    people = profiles(spark, folder)
    return group_sizes(people, boolean_columns(people))


@query("sizes_by_sentiment_and_language", f"""
WITH {SCORED} SELECT sentiment_label, lang, count(*) AS "count" FROM scored
WHERE sentiment_label IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2""")
def _sizes(spark, folder):
    return group_sizes(scored_comments(spark, folder), ["sentiment_label", "lang"])


@query("category_counts", f"""
WITH {PROFILES} SELECT "businessCategoryName", count(*) AS "count" FROM profiles GROUP BY 1""")
def _categories(spark, folder):
    return value_counts(profiles(spark, folder), "businessCategoryName")


@query("sentiment_counts", f"""
WITH {SCORED} SELECT sentiment_label, count(*) AS "count" FROM scored WHERE sentiment_label IS NOT NULL GROUP BY 1""")
def _sentiments(spark, folder):
    return value_counts(scored_comments(spark, folder), "sentiment_label")


@query("weekday_by_type", f"""
WITH {POSTS}
SELECT CAST(isodow(data_hora) - 1 AS INTEGER) AS weekday,
       ['Segunda-feira', 'Terça-feira', 'Quarta-feira', 'Quinta-feira', 'Sexta-feira', 'Sábado', 'Domingo'][isodow(data_hora)]
         AS dia,
       CAST(count(*) FILTER (type = 'F') AS BIGINT) AS "F", CAST(count(*) FILTER (type = 'O') AS BIGINT) AS "O",
       CAST(count(*) FILTER (type = 'P') AS BIGINT) AS "P"
FROM posts GROUP BY 1, 2""")
def _weekdays(spark, folder):
    return weekday_table(posts(spark, folder), "data_hora", "type", ["F", "O", "P"], fill=0)


@query("sentiment_pivot", f"""
WITH {SCORED}
SELECT source, CAST(nullif(count(*) FILTER (sentiment_label = 'negative'), 0) AS DOUBLE) AS negative,
       CAST(nullif(count(*) FILTER (sentiment_label = 'neutral'), 0) AS DOUBLE) AS neutral,
       CAST(nullif(count(*) FILTER (sentiment_label = 'positive'), 0) AS DOUBLE) AS positive
FROM scored GROUP BY 1""")
def _pivot(spark, folder):
    wide = pivot_sizes(scored_comments(spark, folder), "source", "sentiment_label", ["negative", "neutral", "positive"])
    return as_double(wide, "negative", "neutral", "positive")


_BY_SOURCE = f"""
WITH {SCORED},
wide AS (SELECT source, nullif(count(*) FILTER (sentiment_label = 'negative'), 0) AS negative,
                nullif(count(*) FILTER (sentiment_label = 'neutral'), 0) AS neutral,
                nullif(count(*) FILTER (sentiment_label = 'positive'), 0) AS positive
         FROM scored WHERE sentiment_label IS NOT NULL GROUP BY 1),
share AS (SELECT *, negative + neutral + positive AS total FROM wide)"""


@query("sentiment_by_profile", f"""{_BY_SOURCE}
SELECT source, CAST(negative AS DOUBLE) AS negative, CAST(neutral AS DOUBLE) AS neutral, CAST(positive AS DOUBLE) AS positive,
       CAST(total AS DOUBLE) AS "Qtd Comentários", round_even(negative / total * 100, 2) AS "% negative",
       round_even(neutral / total * 100, 2) AS "% neutral", round_even(positive / total * 100, 2) AS "% positive"
FROM share""")
def _by_profile(spark, folder):
    wide = sentiment_by(scored_comments(spark, folder), "source")
    return as_double(wide, "negative", "neutral", "positive", "Qtd Comentários")


@query("top_positive_profiles", f"""{_BY_SOURCE}
SELECT source, round_even(positive / total * 100, 2) AS "% positive" FROM share
ORDER BY 2 DESC NULLS LAST, 1 LIMIT 5""")
def _top_positive(spark, folder):
    return top_by_class(sentiment_by(scored_comments(spark, folder), "source"), "source", "positive")


@query("top_negative_profiles", f"""{_BY_SOURCE}
SELECT source, round_even(negative / total * 100, 2) AS "% negative" FROM share
ORDER BY 2 DESC NULLS LAST, 1 LIMIT 5""")
def _top_negative(spark, folder):
    return top_by_class(sentiment_by(scored_comments(spark, folder), "source"), "source", "negative")


@query("sentiment_shares", f"""
WITH {SCORED}, c AS (SELECT sentiment_label, count(*) AS "count" FROM scored WHERE sentiment_label IS NOT NULL GROUP BY 1)
SELECT sentiment_label, "count", round_even(100.0 * "count" / (SELECT sum("count") FROM c), 1) AS share FROM c""")
def _shares(spark, folder):
    return shares(value_counts(scored_comments(spark, folder), "sentiment_label"))


@query("cluster_sentiment_mix", f"""
WITH {SCORED}, reel AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_size % 4 AS cluster FROM part),
c AS (SELECT sentiment_label, count(*) AS "count" FROM scored JOIN reel ON id_reel = id
      WHERE cluster = 0 AND sentiment_label IS NOT NULL GROUP BY 1)
SELECT sentiment_label, "count", round_even(100.0 * "count" / (SELECT sum("count") FROM c), 1) AS share FROM c""")
def _cluster_mix(spark, folder):
    reels = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("id"), (F.col("p_size") % 4).alias("cluster")
    )
    joined = scored_comments(spark, folder).join(reels, F.col("id_reel") == F.col("id"), "left")
    return shares(group_sizes(joined.where(F.col("cluster") == 0), ["sentiment_label"]))


@query("entities", f"""WITH {SCORED} SELECT DISTINCT "inputUrl" FROM scored WHERE "inputUrl" IS NOT NULL""")
def _entities(spark, folder):
    return reports.entities(scored_comments(spark, folder))


@query("entity_counters", f"""
WITH {SCORED}
SELECT count(DISTINCT id_reel) AS reels, count(DISTINCT id_comment) AS comments,
       CAST(sum("repliesCount") AS BIGINT) AS replies, CAST(sum("likesCount") AS BIGINT) AS likes
FROM scored WHERE "inputUrl" = '{ENTITY}'""")
def _counters(spark, folder):
    return reports.entity_counters(scored_comments(spark, folder), ENTITY)


@query("comment_listing", f"""
WITH {SCORED} SELECT text, "repliesCount", "likesCount" FROM scored WHERE "inputUrl" = '{ENTITY}'""")
def _listing(spark, folder):
    return reports.comment_listing(scored_comments(spark, folder), ENTITY)


@query("first_comment_of_entity", f"""
WITH {SCORED} SELECT source AS title FROM scored WHERE "inputUrl" = '{ENTITY}' ORDER BY id_comment LIMIT 1""")
def _first(spark, folder):
    named = scored_comments(spark, folder).withColumn("ownerFullName", F.col("source"))
    return reports.entity_title(named, ENTITY)


@query("column_profile", """
WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT CAST(p AS INTEGER) AS position, c AS "column", t AS type, n AS non_null, round(1 - n / total, 6) + 0.0 AS null_share
FROM (SELECT 0 AS p, 'doc_id' AS c, 'bigint' AS t, count(doc_id) AS n, count(*) AS total FROM j
      UNION ALL SELECT 1, 'lang', 'string', count(lang), count(*) FROM j
      UNION ALL SELECT 2, 'quality', 'int', count(quality), count(*) FROM j
      UNION ALL SELECT 3, 'toxic', 'int', count(toxic), count(*) FROM j)""")
def _profile(spark, folder):
    joined = table(spark, folder, "documents").select("doc_id", "lang").join(table(spark, folder, "labels"), "doc_id", "left")
    return column_profile(joined).withColumn("null_share", F.round("null_share", 6) + F.lit(0.0))


@query("profiles_without_posts", f"""
WITH {ALL_GOLD} SELECT id, "TOTAL ENGAJAMENTO", "RECENCIA", "FREQUENCIA" FROM gold WHERE "count" = 0""")
def _idle(spark, folder):
    from engagelake.catalog.engagement import gold

    return gold(spark, folder).where(F.col("count") == 0).select("id", "`TOTAL ENGAJAMENTO`", "RECENCIA", "FREQUENCIA")


@query("type_shares", """
WITH c AS (SELECT l_returnflag AS type, count(*) AS "count" FROM lineitem GROUP BY 1)
SELECT type, "count", round_even(100.0 * "count" / (SELECT sum("count") FROM c), 1) AS share FROM c""")
def _type_shares(spark, folder):
    return shares(value_counts(plays(spark, folder), "type"))
