import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engagelake.operators.gold import cluster_table, combined_posts, engagement, sentiment_table, topic_table
from engagelake.plans import reports

POST = "id string, ownerId string, ownerUsername string, commentsCount long, likesCount long, data_hora timestamp_ntz"


def profiles(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, username string, followersCount int")


def posts(spark, *rows):
    return spark.createDataFrame([(f"p{i}", *r) for i, r in enumerate(rows)], POST)


def as_dict(df):
    return {(r["id"], r["ownerUsername"]): r.asDict() for r in df.collect()}


def test_hand_computed_two_owners(spark):
    people = profiles(spark, ("1", "a", 1000), ("2", "b", 2000))
    items = posts(spark, ("1", "a", 10, 100, datetime(2024, 1, 1)), ("2", "b", 20, 200, datetime(2024, 1, 2)))
    got = as_dict(engagement(people, items, items))
    a, b = got["1", "a"], got["2", "b"]
    assert (a["commentsSum"], a["likesSum"], a["count"], a["TOTAL ENGAJAMENTO"]) == (20, 200, 2, 220)
    assert (a["% ENGAJAMENTO"], a["RECENCIA"], a["FREQUENCIA"]) == (0.22, 0.5, 2.0)
    assert (b["TOTAL ENGAJAMENTO"], b["% ENGAJAMENTO"], b["RECENCIA"], b["FREQUENCIA"]) == (440, 0.22, 1.0, 2.0)


def test_hand_computed_two_days(spark):
    got = as_dict(engagement(profiles(spark, ("1", "g", 100)), posts(spark, ("1", "g", 1, 2, datetime(2026, 5, 1))),
                             posts(spark, ("1", "g", 2, 3, datetime(2026, 5, 2))), run_id="r1"))["1", "g"]
    assert (got["TOTAL ENGAJAMENTO"], got["% ENGAJAMENTO"], got["RECENCIA"], got["FREQUENCIA"]) == (8, 0.08, 1.0, 1.0)
    assert got["_run_id"] == "r1"


def test_zero_followers_and_no_posts(spark):
    people = profiles(spark, ("1", "a", 0), ("2", "b", None), ("3", "c", 100), ("4", "d", 50))
    items = posts(spark, *[(i, i, 1, 9, datetime(2024, 1, 1)) for i in "123"], (None, "x", 5, 5, datetime(2024, 1, 1)))
    got = {k[0]: v for k, v in as_dict(engagement(people, items, items.limit(0))).items()}
    assert [got[i]["% ENGAJAMENTO"] for i in "123"] == [0.0, 0.0, 0.1]
    assert (got["4"]["TOTAL ENGAJAMENTO"], got["4"]["RECENCIA"], got["4"]["FREQUENCIA"], got["4"]["count"]) == (0, 1.0, 0.0, 0)
    none = {r["id"]: r["RECENCIA"] for r in engagement(people, items, items.limit(0), no_posts_recency=None).collect()}
    assert none["4"] is None and none["3"] == 1.0


def test_strict_nulls(spark):
    people = profiles(spark, ("1", "a", 0), ("2", "b", 10), ("3", "c", 10))
    items = posts(spark, ("1", "a", 1, 1, datetime(2024, 1, 1)), ("2", "b", 1, 1, datetime(2024, 1, 1)))
    got = {r["id"]: r for r in engagement(people, items, items.limit(0), strict_nulls=True).collect()}
    assert math.isinf(got["1"]["% ENGAJAMENTO"]) and got["2"]["% ENGAJAMENTO"] == 0.2
    assert got["3"]["TOTAL ENGAJAMENTO"] is None and got["3"]["RECENCIA"] is None


def test_owner_with_two_names_fans_out(spark):
    items = posts(spark, ("1", "a", 1, 1, datetime(2024, 1, 1)), ("1", "old", 2, 2, datetime(2024, 1, 1)))
    assert len(as_dict(engagement(profiles(spark, ("1", "a", 10)), items, items.limit(0)))) == 2


def test_latest_time_counts_profiles_only(spark):
    items = posts(spark, ("1", "a", 1, 1, datetime(2024, 1, 1)), ("9", "stranger", 1, 1, datetime(2024, 2, 1)))
    assert as_dict(engagement(profiles(spark, ("1", "a", 10)), items, items.limit(0)))["1", "a"]["RECENCIA"] == 1.0


def test_partitioning_does_not_matter(spark):
    people = profiles(spark, *[(str(i), f"u{i}", i * 10) for i in range(20)])
    items = posts(spark, *[(str(i % 7), f"u{i % 7}", i, i * 2, datetime(2024, 1, 1 + i % 28)) for i in range(200)])
    once = as_dict(engagement(people, items, items))
    again = as_dict(engagement(people.repartition(7), items.orderBy(F.rand(3)), items.repartition(5)))
    assert once == again


def test_shuffle_is_reused_for_the_latest_time(spark):
    people = profiles(spark, *[(str(i), f"u{i}", i * 10) for i in range(20)])
    items = posts(spark, *[(str(i % 7), f"u{i % 7}", i, i * 2, datetime(2024, 1, 1)) for i in range(200)])
    df = engagement(people, items, items)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_union_fills_missing_columns(spark):
    both = combined_posts(spark.sql("SELECT '1' AS id, 'c' AS caption"), spark.sql("SELECT '2' AS id, 5 AS plays"))
    assert {tuple(r) for r in both.collect()} == {("1", "c", None), ("2", None, 5)}


def test_gold_tables_have_their_contract(spark):
    scored = spark.sql("SELECT 'c' AS id_comment, 'positive' AS sentiment_label, 0.5D AS sentiment_score")
    assert sentiment_table(scored, "r").first()["Topic"] is None
    labelled = spark.sql("SELECT 1 AS id, 'u' AS username, 3 AS cluster")
    assert cluster_table(labelled, "KMeans", 0.4, "r").first()["cluster_label"] == 3
    assert topic_table(spark.sql("SELECT 1L AS Topic, 'n' AS Name, 2L AS Count"), "r").first()["_run_id"] == "r"


def test_kpis_are_means_of_ratios(spark):
    gold = spark.sql("""SELECT * FROM VALUES (10, 1, 1, 10L, 4L, 2L, 0.5D, 'a', 1.0D), (30, 3, 3, 0L, 0L, 0L, 0.25D, 'b', 2.0D)
        AS t(followersCount, followsCount, postsCount, commentsSum, likesSum, count, `% ENGAJAMENTO`, username, FREQUENCIA)""")
    row = reports.kpis(gold).first()
    assert (row["mean_followers"], row["comments_per_post"], row["likes_per_post"], row["mean_engagement"]) == (20, 5, 2, 0.38)
    page = reports.exploratory(gold)
    assert page["top_frequency"].first()["username"] == "b" and page["correlation"].count() == 64


@pytest.mark.parametrize("limit", [None, 2])
def test_scatter(spark, limit):
    assert reports.scatter(spark.range(5).selectExpr("id AS x", "id AS y"), "x", "y", limit).count() == (limit or 5)


def test_entity_page(spark):
    comments = spark.sql("""SELECT * FROM VALUES ('u', 'r1', 'c1', 'hey', 2L, 5L), ('u', 'r1', 'c2', 'yo', 1L, 1L), ('v', 'r2', 'c3', 'x', 9L, 9L)
        AS t(inputUrl, id_reel, id_comment, text, repliesCount, likesCount)""")
    reels = spark.sql("""SELECT * FROM VALUES ('u', 'r1', 3L, 4L), ('u', 'r9', NULL, 10L), ('v', 'r2', 1L, 1L)
        AS t(inputUrl, id, commentsCount, likesCount)""")
    page = reports.modelling(comments, reels, "u")
    assert tuple(page["counters"].first()) == (1, 2, 3, 6)
    assert [r["id"] for r in page["top_reels"].collect()] == ["r9", "r1"]
    assert page["comments"].count() == 2 and page["title"].first()["title"] is None
    assert {r[0] for r in reports.entities(comments).collect()} == {"u", "v"}
