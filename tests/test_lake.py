import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from engagelake.config import LakeConfig
from engagelake.operators.gold import sentiment_table
from engagelake.plans import jobs
from engagelake.schemas import BRONZE_PROFILES, REEL_HINTS, apply_hints
from engagelake.sources.files import (
    export_csv,
    load_table,
    read_json,
    read_seeds,
    save_tables,
    seed_links,
    write_json,
)
from engagelake.sources.lake import Lake, as_of, new_run_id

EARLY, LATE = datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 2, 1, tzinfo=timezone.utc)


def batch(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "id string, username string")


def test_append_only_runs(lake, spark):
    assert lake.append("profiles", batch(spark, "1"), "r1", now=EARLY) == ("r1", 1)
    lake.append("profiles", batch(spark, "2"), "r2", now=LATE)
    stored = lake.bronze("profiles")
    assert stored.count() == 2 and {r[0] for r in stored.select("_run_id").distinct().collect()} == {"r1", "r2"}
    history = lake.history("profiles").orderBy("version").collect()
    assert [(r["_run_id"], r["version"], r["rows"]) for r in history] == [("r1", 0, 1), ("r2", 1, 1)]


def test_as_of(lake, spark):
    lake.append("profiles", batch(spark, "1"), "r1", now=EARLY)
    lake.append("profiles", batch(spark, "2", "3"), "r2", now=LATE)
    assert lake.bronze_at("profiles", version=0).count() == 1
    assert lake.bronze_at("profiles", version=1, timestamp="1999-01-01").count() == 3  # the version wins
    assert lake.bronze_at("profiles", timestamp="2026-01-15 00:00:00").count() == 1
    with pytest.raises(ValueError):
        lake.bronze_at("profiles")
    with pytest.raises(ValueError):
        as_of(lake.bronze("profiles"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_reads_the_log_and_prunes_runs(lake, spark):
    for number in range(4):
        lake.append("profiles", batch(spark, str(number)), f"r{number}/a b", now=EARLY)
    for df in (lake.bronze_at("profiles", version=1), lake.bronze_at("profiles", timestamp="2026-01-01 00:00:00")):
        plan = plan_of(df)
        assert "dynamicpruning" in plan and plan.count("FileScan parquet") == 1 and "Window" not in plan
    df = lake.bronze_at("profiles", version=1)
    df.collect()
    scanned = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in scanned and {r["id"] for r in df.collect()} == {"0", "1"}
    history = plan_of(lake.history("profiles"))
    assert "FileScan parquet" not in history and "Window" not in history and "FileScan json" in history


def test_a_run_that_appends_again_keeps_its_version(lake, spark):
    lake.append("profiles", batch(spark, "1"), "r1", now=EARLY)
    lake.append("profiles", batch(spark, "2"), "r2", now=LATE)
    lake.append("profiles", batch(spark, "3", "4"), "r1", now=LATE)
    history = {r["_run_id"]: r for r in lake.history("profiles").collect()}
    assert (history["r1"]["version"], history["r1"]["rows"], history["r2"]["version"]) == (0, 3, 1)
    assert history["r1"]["first_ingested_at"] < history["r1"]["last_ingested_at"] == history["r2"]["last_ingested_at"]
    assert {r["id"] for r in lake.bronze_at("profiles", version=0).collect()} == {"1", "3", "4"}


def test_adopted_rows_keep_their_runs(lake, spark):
    rows = spark.createDataFrame([("1", "b", LATE), ("2", "a", EARLY), ("3", "a", EARLY)], "id string, _run_id string, _ingested_at timestamp")
    assert lake.adopt("profiles", rows) == 2 and lake.adopt("profiles", rows.where("id = '1'").withColumn("_run_id", F.lit("c"))) == 1
    got = [(r["_run_id"], r["rows"]) for r in lake.history("profiles").orderBy("version").collect()]
    assert got == [("a", 2), ("b", 1), ("c", 1)] and {r["id"] for r in lake.bronze_at("profiles", version=0).collect()} == {"2", "3"}


def test_versions_are_claimed_once(lake, spark):
    from concurrent.futures import ThreadPoolExecutor

    from engagelake.sources import runlog

    folder = lake.runs_folder("posts")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: runlog.commit(spark, folder, f"run-{k}", EARLY, EARLY, k), range(12)))
    assert sorted(got) == list(range(12)) and runlog.history(spark, folder).count() == 12
    # A batch that is replayed replaces its entry.
    for rows in (5, 7):
        runlog.commit(spark, folder, "stream", EARLY, LATE, rows, entry="batch")
    assert runlog.history(spark, folder).where("_run_id = 'stream'").first()["rows"] == 7


def test_a_table_without_a_log_is_indexed(lake, spark):
    lake.append("profiles", batch(spark, "1"), "r1", now=EARLY)
    lake.append("profiles", batch(spark, "2"), "r2", now=LATE)
    import shutil

    shutil.rmtree(lake.runs_folder("profiles"))
    assert [r["_run_id"] for r in lake.history("profiles").orderBy("version").collect()] == ["r1", "r2"]
    assert lake.reindex("profiles") == 0 and lake.bronze_at("profiles", version=0).count() == 1


def test_run_filter_reaches_the_scan(lake, spark):
    lake.append("profiles", batch(spark, "1"), "r1")
    plan = lake.bronze("profiles").where("_run_id = 'r1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_run_id" in plan


def test_numeric_run_ids_stay_text(lake, spark):
    lake.append("profiles", batch(spark, "1"), "20260101")
    assert lake.bronze("profiles").first()["_run_id"] == "20260101"


def test_errors(lake, spark):
    with pytest.raises(ValueError):
        lake.append("profiles", batch(spark), "r1")
    with pytest.raises(ValueError):
        lake.append("people", batch(spark, "1"), "r1")
    with pytest.raises(FileNotFoundError):
        lake.bronze("posts")
    with pytest.raises(FileNotFoundError):
        lake.load("profiles")
    with pytest.raises(ValueError):
        lake.load("people")


def test_nested_values_are_stored_as_json(lake, spark):
    reels = spark.sql("SELECT '1' AS id, array(named_struct('id', 'c', 'text', 'é')) AS latestComments")
    lake.append("reels", reels, "r1")
    assert json.loads(lake.bronze("reels").first()["latestComments"]) == [{"id": "c", "text": "é"}]


def test_replace_may_read_the_table_it_replaces(lake, spark):
    topics = spark.sql("SELECT 1L AS Topic, 'n' AS Name, 5L AS Count, 'r' AS _run_id, timestamp'2026-01-01' AS _generated_at")
    assert lake.replace("gold", "topics", topics) == 1
    lake.replace("gold", "topics", lake.table("gold", "topics").withColumn("Count", F.col("Count") + 1))
    assert lake.load("topics").first()["Count"] == 6


def test_comments_fall_back_to_clean_ones(lake, spark):
    clean = spark.sql("""SELECT 'r' AS id_reel, 'c' AS id_comment, 'hey' AS text, 3L AS `comprimento texto`,
        timestamp'2026-01-01' AS _ingested_at, 'r1' AS _run_id, 'bronze' AS _source_layer""")
    lake.replace("silver", "comments", clean)
    assert "comprimento texto" in lake.load("comments").columns
    lake.replace("gold", "sentiment", sentiment_table(clean.withColumn("sentiment_label", F.lit("positive")), "r2"))
    assert lake.load("comments").first()["sentiment_label"] == "positive"
    assert lake.views() == ["comments"] and spark.sql("SELECT count(*) FROM comments").first()[0] == 1


def test_json_files(spark, tmp_path):
    path = str(tmp_path / "p.json")
    with pytest.raises(FileNotFoundError):
        read_json(spark, path, BRONZE_PROFILES)
    (tmp_path / "p.json").write_text('[{"id": "1", "followersCount": 5}, {"id": "2"}]', encoding="utf-8")
    assert read_json(spark, path, BRONZE_PROFILES).count() == 2
    (tmp_path / "bad.json").write_text('[{"id": ', encoding="utf-8")
    with pytest.raises(ValueError):
        read_json(spark, str(tmp_path / "bad.json"), BRONZE_PROFILES)
    write_json(spark.sql("SELECT 'é' AS a"), str(tmp_path / "out"))
    assert "é" in next((tmp_path / "out").glob("*.json")).read_text(encoding="utf-8")


def test_seeds_tables_and_exports(spark, tmp_path):
    (tmp_path / "seeds.csv").write_text("Nome, Link \nA, http://x \nB,http://x\nC,http://y\n", encoding="utf-8")
    assert sorted(r[0] for r in read_seeds(spark, str(tmp_path / "seeds.csv")).collect()) == ["http://x", "http://y"]
    assert seed_links(spark.sql("SELECT ' a ' AS ` Link `")).first()[0] == "a"
    written = save_tables({"a": spark.range(3), "b": spark.range(2)}, str(tmp_path / "t"))
    assert set(written) == {"a", "b"} and load_table(spark, str(tmp_path / "t"), "a").count() == 3
    export_csv(spark.range(2), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_text().startswith("id")
    hinted = apply_hints(spark.sql("SELECT 1 AS id, '7' AS likesCount"), REEL_HINTS)
    assert dict(hinted.dtypes) == {"id": "string", "likesCount": "bigint"}


@pytest.fixture
def raw_dir(tmp_path):
    raw = tmp_path / "lake" / "raw"
    raw.mkdir(parents=True)
    person = {"id": "1", "username": "g", "followersCount": 100, "followsCount": 1, "postsCount": 2, "biography": "x"}
    item = {"id": "p1", "ownerId": "1", "ownerUsername": "g", "commentsCount": 1, "likesCount": 2,
            "timestamp": "2026-05-01T12:00:00+00:00", "hashtags": ["a"]}
    reel = {**item, "id": "r1", "commentsCount": 2, "likesCount": 3, "timestamp": "2026-05-02T12:00:00+00:00",
            "isPinned": True, "latestComments": [{"id": "c1", "text": "oi", "likesCount": 1}]}
    for name, rows in {"profiles": [person], "posts": [item], "reels": [reel]}.items():
        (raw / f"{name}.json").write_text(json.dumps(rows), encoding="utf-8")
    return str(raw)


def test_whole_run(lake, raw_dir):
    report = jobs.medallion(lake, raw_dir, "r1")
    assert report["bronze"]["status"] == "bronze_complete" and report["silver"]["status"] == "silver_complete"
    assert report["gold"] == {"run_id": "r1", "status": "gold_complete", "engagement": 1}
    row = lake.load("profiles").first()
    assert (row["TOTAL ENGAJAMENTO"], row["% ENGAJAMENTO"], row["RECENCIA"], row["FREQUENCIA"]) == (8, 0.08, 1.0, 1.0)
    assert lake.load("comments").first()["text"] == "oi"
    # A second run finds Bronze filled; a forced one appends again.
    assert jobs.medallion(lake, raw_dir)["bronze"]["status"] == "bronze_present"
    assert jobs.ingest(lake, raw_dir, "r2", force=True)["profiles"] == 1
    assert lake.bronze("posts").count() == 2


def test_backfill(lake, raw_dir, spark):
    modeled = spark.sql("SELECT 'r1' AS id_reel, 'c1' AS id_comment, 'oi' AS text, 'Positive' AS sentiment_label, 0.9D AS sentiment_score")
    report = jobs.backfill(lake, raw_dir, modeled)
    assert report["status"] == "backfill_complete" and report["sentiment"] == 1
    assert lake.load("comments").first()["_run_id"] == jobs.BACKFILL_RUN_ID
    assert jobs.backfill(lake, raw_dir + "/nowhere")["missing"] == ["profiles", "posts", "reels"]


def test_job_arguments(lake, spark, raw_dir, tmp_path):
    for stage in (jobs.silver, jobs.gold):
        with pytest.raises(ValueError, match="run_id"):
            stage(lake, "")
    with pytest.raises(ValueError, match="posts"):
        jobs.bronze(lake, {"profiles": batch(spark, "1"), "reels": batch(spark, "1")})
    with pytest.raises(RuntimeError, match=r"\[BRONZE\]"):
        jobs.medallion(lake, str(tmp_path / "nowhere"))
    report = jobs.main(["all", "--data-root", lake.config.data_root, "--run-id", "x"], spark)
    assert report["run_id"] == "x"


def test_run_ids_and_settings(spark, monkeypatch):
    import re

    assert re.fullmatch(r"\d{8}_\d{6}_[0-9a-f]{8}", new_run_id())
    monkeypatch.setenv("ENGAGELAKE_DATA_ROOT", "s3a://bucket/x/")
    monkeypatch.setenv("ENGAGELAKE_SEED", "7")
    config = LakeConfig()
    assert (config.layer("gold"), config.seed, config.results_limit) == ("s3a://bucket/x/gold", 7, 30)
    assert Lake(spark, config).path("silver", "posts") == "s3a://bucket/x/silver/posts"
