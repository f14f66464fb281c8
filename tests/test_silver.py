import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from engagelake.operators.silver import clean_comments, clean_posts, clean_profiles, clean_reels, comments_view
from engagelake.schemas import BRONZE_PROFILES, SILVER_PROFILES, conform, encode_nested, numeric_columns


def test_profiles_are_tagged_and_named(spark):
    raw = spark.createDataFrame(
        [("1", "g", 100, datetime(2026, 5, 1), "r1", "bio")],
        "id string, username string, followersCount long, _ingested_at timestamp, _run_id string, biography string",
    )
    row = clean_profiles(raw).first().asDict()
    assert row["_source_layer"] == "bronze" and row["fullName"] == "g" and "biography" not in row
    linked = clean_profiles(raw.drop("username").withColumn("inputUrl", F.lit("u"))).first()
    assert linked["fullName"] == "u"
    assert clean_profiles(raw.select("id")).first()["fullName"] is None


def test_keep_latest_per_id(spark):
    rows = [("1", "old", datetime(2026, 1, 1)), ("1", "new", datetime(2026, 1, 3)), ("1", "undated", None),
            (None, "x", datetime(2026, 1, 1)), (None, "y", datetime(2026, 1, 2))]
    raw = spark.createDataFrame(rows, "id string, username string, _ingested_at timestamp")
    assert sorted((r["id"] or "", r["username"]) for r in clean_profiles(raw).collect()) == [("", "y"), ("1", "new")]


def test_posts_and_reels(spark):
    raw = spark.createDataFrame(
        [("p1", "1", "g", "1.0", None, "2026-05-01T00:00:00+00:00", "[]", 1.0, datetime(2026, 5, 1), "r1")],
        "id string, ownerId string, ownerUsername string, commentsCount string, likesCount string, timestamp string, "
        "latestComments string, isPinned double, _ingested_at timestamp, _run_id string",
    )
    post, reel = clean_posts(raw).first(), clean_reels(raw).first()
    assert (post["Tipo"], reel["Tipo"]) == ("FEED", "REELS")
    assert post["data_hora"] == datetime(2026, 4, 30, 21)
    assert (reel["commentsCount"], reel["likesCount"], reel["Total de Engajamento"]) == (1, 0, 1)
    assert reel["isPinned"] is True


def test_runs_add_up_unless_keys_are_given(spark):
    rows = [("p1", 1, datetime(2026, 5, 1), "r1"), ("p1", 2, datetime(2026, 5, 2), "r2")]
    raw = spark.createDataFrame(rows, "id string, likesCount long, _ingested_at timestamp, _run_id string")
    assert clean_posts(raw).count() == 2
    assert [r["likesCount"] for r in clean_posts(raw, dedupe_keys=["id"]).collect()] == [2]


def _reels(spark, *lists):
    return spark.createDataFrame(
        [(f"r{i}", json.dumps(x) if x is not None else None) for i, x in enumerate(lists)], "id string, latestComments string"
    )


def test_comments(spark):
    three = [{"id": "a", "text": "x" * 511}, {"id": "b", "text": "x" * 512}, {"id": "c", "text": None}]
    twins = [{"id": "d", "text": "ok"}, {"id": "d", "text": "ok"}, None]
    got = {r["id_comment"]: r for r in clean_comments(_reels(spark, three, [], None, twins)).collect()}
    assert set(got) == {"a", "c", "d"}
    assert got["a"]["comprimento texto"] == 511 and got["c"]["comprimento texto"] == 0


def test_equal_comments_of_other_runs_stay(spark):
    reels = _reels(spark, [{"id": "a", "text": "x"}])
    runs = reels.withColumn("_run_id", F.explode(F.array(F.lit("r1"), F.lit("r2"), F.lit("r2"))))
    assert clean_comments(runs).count() == 2
    counted = runs.withColumn("likesCount", F.monotonically_increasing_id())
    assert clean_comments(counted).count() == 3  # the reel rows differ


def test_comments_accept_structs(spark):
    rows = spark.createDataFrame([(1, ("x" * 600,)), (2, ("fine",))], "id long, latestComments struct<text:string>")
    got = clean_comments(rows, element=None).collect()
    assert [r["text"] for r in got] == ["fine"] and all(r["comprimento texto"] < 512 for r in got)
    wide = comments_view(rows)
    assert wide.count() == 1 and wide.columns == ["id", "text", "comprimento texto"]


def test_wide_view_names(spark):
    wide = comments_view(_reels(spark, [{"id": "a", "text": "t", "owner": {"username": "u"}}], []), keep_empty=True)
    assert {"id_reel", "id_comment", "owner.username", "text"} <= set(wide.columns)
    assert wide.count() == 2
    assert comments_view(_reels(spark, [{"id": "a", "text": "t"}], [])).count() == 1


def test_no_comment_column(spark):
    df = clean_comments(spark.createDataFrame([("r",)], "id string"))
    assert df.isEmpty() and "id_comment" in df.columns


def test_conform(spark):
    raw = spark.createDataFrame([("1", 5, "x")], "id string, followersCount int, extra string")
    stamped = raw.withColumns({"_ingested_at": F.lit("2026-01-01").cast("timestamp"), "_run_id": F.lit("r"), "_source": F.lit("s")})
    out = conform(stamped, BRONZE_PROFILES)
    assert out.columns == BRONZE_PROFILES.names and out.first()["username"] is None
    with pytest.raises(Exception, match="null in required column"):
        conform(stamped, SILVER_PROFILES).collect()


def test_nested_columns_become_json(spark):
    df = spark.createDataFrame([(["é", "b"], (1,))], "a array<string>, s struct<k:int>")
    assert tuple(encode_nested(df).first()) == ('["é","b"]', '{"k":1}')
    assert numeric_columns(spark.sql("SELECT 1 AS a, true AS b, 'x' AS c, 1.5D AS d")) == ["a", "d"]
