"""Gold engagement and what is built straight on it."""

from __future__ import annotations

from engagelake.catalog.registry import ALL_GOLD, JOINED, POSTS, PROFILES, REELS, TOTALS, as_double, query, rounded
from engagelake.operators.distribution import two_series
from engagelake.operators.frequency import latest_per_owner, top_n
from engagelake.operators.gold import combined_posts, engagement, owner_totals
from engagelake.plans import reports
from engagelake.sources import adapters

METRICS = ["% ENGAJAMENTO", "RECENCIA", "FREQUENCIA"]
COLUMNS = ["id", "username", "followersCount", "commentsSum", "likesSum", "minData", "maxData", "count",
           "TOTAL ENGAJAMENTO", *METRICS]


def gold(spark, folder):
    return engagement(*[f(spark, folder) for f in (adapters.profiles, adapters.posts, adapters.reels)])


_GOLD_OUT = """
SELECT id, username, "followersCount", "commentsSum", "likesSum", "minData", "maxData", "count", "TOTAL ENGAJAMENTO",
       round("% ENGAJAMENTO", 6) + 0.0 AS "% ENGAJAMENTO", round("RECENCIA", 6) + 0.0 AS "RECENCIA",
       round("FREQUENCIA", 6) + 0.0 AS "FREQUENCIA"
FROM gold"""


@query("engagement", f"WITH {ALL_GOLD} {_GOLD_OUT}")
def _engagement(spark, folder):
    return rounded(gold(spark, folder).select(*[f"`{c}`" for c in COLUMNS]), 6, *METRICS)


_STRICT = """
strict AS (
  SELECT id, username, "followersCount", CAST("commentsSum" AS DOUBLE) AS "commentsSum",
         CAST("likesSum" AS DOUBLE) AS "likesSum", "minData", "maxData", CAST("count" AS DOUBLE) AS "count",
         CAST("commentsSum" + "likesSum" AS DOUBLE) AS "TOTAL ENGAJAMENTO",
         CASE WHEN "followersCount" = 0 THEN
           CASE WHEN "commentsSum" + "likesSum" > 0 THEN CAST('inf' AS DOUBLE) END
         ELSE ("commentsSum" + "likesSum") / "followersCount" END AS "% ENGAJAMENTO",
         1.0 / (datesub('day', "maxData", (SELECT max("maxData") FROM joined)) + 1) AS "RECENCIA",
         "count" / (datesub('day', "minData", "maxData") + 1) AS "FREQUENCIA"
  FROM joined)"""


@query("engagement_strict_nulls",
       f"WITH {','.join([PROFILES, POSTS, REELS, TOTALS, JOINED, _STRICT])} {_GOLD_OUT.replace('FROM gold', 'FROM strict')}")
def _strict(spark, folder):
    tables = [f(spark, folder) for f in (adapters.profiles, adapters.posts, adapters.reels)]
    table = engagement(*tables, strict_nulls=True).select(*[f"`{c}`" for c in COLUMNS])
    return as_double(rounded(table, 6, *METRICS), "commentsSum", "likesSum", "count", "TOTAL ENGAJAMENTO")


@query("owner_totals", f"WITH {','.join([POSTS, REELS, TOTALS])} SELECT * FROM totals")
def _totals(spark, folder):
    return owner_totals(combined_posts(adapters.posts(spark, folder), adapters.reels(spark, folder)))


@query("combined_posts", f"""
WITH {POSTS}, {REELS}
SELECT id, "ownerId", "Tipo", "commentsCount", "likesCount", CAST(NULL AS DOUBLE) AS "videoPlayCount", data_hora FROM posts
UNION ALL SELECT id, "ownerId", "Tipo", "commentsCount", "likesCount", CAST("videoPlayCount" AS DOUBLE) AS "videoPlayCount", data_hora FROM reels""")
def _combined(spark, folder):
    both = combined_posts(adapters.posts(spark, folder), adapters.reels(spark, folder))
    slim = both.select("id", "ownerId", "Tipo", "commentsCount", "likesCount", "videoPlayCount", "data_hora")
    return as_double(slim, "videoPlayCount")


@query("kpis", f"""
WITH {ALL_GOLD}
SELECT round_even(avg("followersCount"), 2) AS mean_followers, round_even(avg("followsCount"), 2) AS mean_follows,
       round_even(avg("postsCount"), 2) AS mean_posts,
       round_even(avg("commentsSum" / nullif("count", 0)), 2) AS comments_per_post,
       round_even(avg("likesSum" / nullif("count", 0)), 2) AS likes_per_post,
       round_even(avg("% ENGAJAMENTO"), 2) AS mean_engagement
FROM gold""")
def _kpis(spark, folder):
    return reports.kpis(gold(spark, folder))


def _top_sql(metric: str) -> str:
    return f"""WITH {ALL_GOLD} SELECT username, round("{metric}", 6) AS "{metric}" FROM gold
    ORDER BY gold."{metric}" DESC NULLS LAST, username LIMIT 5"""


@query("top_frequency", _top_sql("FREQUENCIA"))
def _top_frequency(spark, folder):
    best = top_n(gold(spark, folder), "FREQUENCIA", "username")
    return rounded(best.select("username", "FREQUENCIA"), 6, "FREQUENCIA")


@query("top_engagement", _top_sql("% ENGAJAMENTO"))
def _top_engagement(spark, folder):
    best = top_n(gold(spark, folder), "% ENGAJAMENTO", "username")
    return rounded(best.select("username", "`% ENGAJAMENTO`"), 6, "% ENGAJAMENTO")


@query("followers_against_engagement", f"""
WITH {ALL_GOLD} SELECT username, "followersCount", round("% ENGAJAMENTO", 6) + 0.0 AS "% ENGAJAMENTO" FROM gold
ORDER BY "followersCount" DESC NULLS LAST, username""")
def _two_series(spark, folder):
    pair = two_series(gold(spark, folder), "username", "followersCount", "% ENGAJAMENTO")
    return rounded(pair, 6, "% ENGAJAMENTO")


@query("interactions_per_profile", f"""
WITH {ALL_GOLD} SELECT username, "likesSum", "commentsSum", "likesSum" + "commentsSum" AS interactions FROM gold""")
def _interactions(spark, folder):
    return reports.interactions(gold(spark, folder))


@query("plays_likes_pairs", """
SELECT CAST(floor(l_extendedprice) AS BIGINT) AS "videoPlayCount", CAST(floor(l_quantity) AS BIGINT) AS "likesCount"
FROM lineitem""")
def _scatter(spark, folder):
    return reports.scatter(adapters.plays(spark, folder), "videoPlayCount", "likesCount")


@query("latest_posts_per_owner", f"""
WITH {POSTS} SELECT id, "ownerId", data_hora FROM (
  SELECT *, row_number() OVER (PARTITION BY "ownerId" ORDER BY data_hora DESC NULLS LAST, id) AS r FROM posts)
WHERE r <= 30""")
def _latest_posts(spark, folder):
    return latest_per_owner(adapters.posts(spark, folder), 30).select("id", "ownerId", "data_hora")


@query("top_reels", """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS id,
       CAST(l_linenumber + floor(l_quantity) AS BIGINT) AS "Total de Engajamento"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
ORDER BY 2 DESC, 1 LIMIT 10""")
def _top_reels(spark, folder):
    return reports.top_reels(adapters.reels(spark, folder)).select("id", "`Total de Engajamento`")
