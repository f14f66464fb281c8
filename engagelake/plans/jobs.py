"""Stage jobs: Bronze, Silver, Gold, backfill and the whole run."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from engagelake.config import LakeConfig
from engagelake.operators.gold import engagement, sentiment_table
from engagelake.operators.silver import clean_comments, clean_posts, clean_profiles, clean_reels
from engagelake.schemas import CONTRACTS, present_columns
from engagelake.session import get_spark
from engagelake.sources.files import exists, read_json
from engagelake.sources.lake import BRONZE, Lake, new_run_id

BACKFILL_RUN_ID = "backfill_v1"


def _require(**given) -> None:
    missing = [name for name, value in given.items() if not value]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}")


def read_raw(lake: Lake, raw_dir: str | None = None) -> dict[str, DataFrame]:
    """profiles.json, posts.json and reels.json with the Bronze contracts (lineage aside) as read schemas."""
    root = raw_dir or lake.config.layer("raw")
    out = {}
    for entity in BRONZE:
        schema = CONTRACTS[f"bronze_{entity}"]
        body = type(schema)([f for f in schema if not f.name.startswith("_")])
        out[entity] = read_json(lake.spark, f"{root}/{entity}.json", body)
    return out


def missing_raw(lake: Lake, raw_dir: str | None = None) -> list[str]:
    root = raw_dir or lake.config.layer("raw")
    return [e for e in BRONZE if not exists(lake.spark, f"{root}/{e}.json")]


def bronze(lake: Lake, tables: dict[str, DataFrame], run_id: str | None = None) -> dict:
    """Append one batch per entity under one run id."""
    _require(lake=lake, **{e: e in (tables or {}) for e in BRONZE})
    run_id = run_id or new_run_id()
    counts = {e: lake.append(e, tables[e], run_id)[1] for e in BRONZE}
    return {"run_id": run_id, "status": "bronze_complete", **counts}


def silver(lake: Lake, run_id: str, dedupe_keys: list[str] | None = None) -> dict:
    """Clean all Bronze runs into the four Silver tables."""
    _require(lake=lake, run_id=run_id)
    reels = lake.bronze("reels")
    zone = lake.config.zone
    counts = {
        "profiles": lake.replace("silver", "profiles", clean_profiles(lake.bronze("profiles"))),
        "posts": lake.replace("silver", "posts", clean_posts(lake.bronze("posts"), zone, dedupe_keys)),
        "reels": lake.replace("silver", "reels", clean_reels(reels, zone, dedupe_keys)),
        "comments": lake.replace("silver", "comments", clean_comments(reels)),
    }
    return {"run_id": run_id, "status": "silver_complete", **counts}


def gold(lake: Lake, run_id: str) -> dict:
    """Engagement per profile from the written Silver tables."""
    _require(lake=lake, run_id=run_id)
    table = engagement(
        lake.table("silver", "profiles").drop("_run_id", "_ingested_at", "_source_layer"),
        lake.table("silver", "posts"),
        lake.table("silver", "reels"),
        run_id,
    )
    return {"run_id": run_id, "status": "gold_complete", "engagement": lake.replace("gold", "engagement", table)}


def ingest(lake: Lake, raw_dir: str | None = None, run_id: str | None = None, force: bool = False) -> dict:
    """Use Bronze when it has data; else load the raw files. ``force`` always loads the raw files."""
    if not force and lake.has("bronze", "profiles") and not lake.bronze("profiles").isEmpty():
        return {"run_id": run_id or new_run_id(), "status": "bronze_present"}
    absent = missing_raw(lake, raw_dir)
    if absent:
        raise ValueError(f"no bronze data and no raw files for {', '.join(absent)}")
    return bronze(lake, read_raw(lake, raw_dir), run_id)


def medallion(lake: Lake, raw_dir: str | None = None, run_id: str | None = None, force: bool = False) -> dict:
    """Bronze, Silver and Gold in one go; errors name the stage that failed."""
    report: dict = {}
    run_id = run_id or new_run_id()
    stages = [
        ("BRONZE", lambda: ingest(lake, raw_dir, run_id, force)),
        ("SILVER", lambda: silver(lake, run_id)),
        ("GOLD", lambda: gold(lake, run_id)),
    ]
    for stage, work in stages:
        try:
            report[stage.lower()] = work()
        except Exception as error:
            raise RuntimeError(f"[{stage}] {error}") from error
    return {"run_id": run_id, **report}


def backfill(lake: Lake, raw_dir: str | None = None, modeled: DataFrame | None = None, run_id: str = BACKFILL_RUN_ID) -> dict:
    """Load existing raw files, and comments that already carry a sentiment, into all layers under one run id."""
    absent = missing_raw(lake, raw_dir)
    if absent:
        return {"run_id": run_id, "status": "inputs_missing", "missing": absent}
    report = {"run_id": run_id, "bronze": bronze(lake, read_raw(lake, raw_dir), run_id)}
    report["silver"] = silver(lake, run_id)
    report["gold"] = gold(lake, run_id)
    if modeled is not None and present_columns(modeled, ["sentiment_label"]):
        report["sentiment"] = lake.replace("gold", "sentiment", sentiment_table(modeled, run_id))
    return {**report, "status": "backfill_complete"}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(description="Run one stage, or all of them.")
    parser.add_argument("stage", choices=["bronze", "silver", "gold", "all", "backfill"])
    parser.add_argument("--data-root", required=True)
    parser.add_argument("--raw-dir")
    parser.add_argument("--run-id")
    parser.add_argument("--force", action="store_true")
    args = parser.parse_args(argv)
    lake = Lake(spark or get_spark("engagelake-job"), LakeConfig(data_root=args.data_root))
    if args.stage == "bronze":
        report = bronze(lake, read_raw(lake, args.raw_dir), args.run_id)
    elif args.stage == "silver":
        report = silver(lake, args.run_id)
    elif args.stage == "gold":
        report = gold(lake, args.run_id)
    elif args.stage == "backfill":
        report = backfill(lake, args.raw_dir)
    else:
        report = medallion(lake, args.raw_dir, args.run_id, args.force)
    print(json.dumps(report, default=str))
    return report


if __name__ == "__main__":
    main()
