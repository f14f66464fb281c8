import json
import random
from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from engagelake.streaming import running
from engagelake.streaming.ingest import ingest_stream, stream_json
from engagelake.streaming.running import current_totals, running_changes, running_totals, summed_changes, write_changes


def test_each_file_lands_once(lake, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps([{"id": "1"}, {"id": "2"}]))
    for expected in (2, 2):
        stream = stream_json(lake, "profiles", str(inbox))
        ingest_stream(lake, "profiles", stream, str(tmp_path / "progress")).awaitTermination()
        assert lake.bronze("profiles").count() == expected
    (inbox / "b.json").write_text(json.dumps([{"id": "3"}]))
    ingest_stream(lake, "profiles", stream_json(lake, "profiles", str(inbox)), str(tmp_path / "progress")).awaitTermination()
    assert {r["id"] for r in lake.bronze("profiles").collect()} == {"1", "2", "3"}
    assert lake.history("profiles").count() == 2


def test_streams_never_touch_each_others_runs(lake, tmp_path):
    for name in ("a", "b"):
        inbox = tmp_path / name
        inbox.mkdir()
        (inbox / "x.json").write_text(json.dumps([{"id": f"{name}1"}, {"id": f"{name}2"}]))
        ingest_stream(lake, "profiles", stream_json(lake, "profiles", str(inbox)), str(tmp_path / f"{name}-progress")).awaitTermination()
    assert {r["id"] for r in lake.bronze("profiles").collect()} == {"a1", "a2", "b1", "b2"}
    # A lost checkpoint reads the folder again into a run of its own.
    ingest_stream(lake, "profiles", stream_json(lake, "profiles", str(tmp_path / "a")), str(tmp_path / "lost")).awaitTermination()
    assert lake.history("profiles").count() == 3 and lake.bronze("profiles").count() == 6


def test_a_replayed_batch_replaces_itself(lake, tmp_path):
    inbox, progress = tmp_path / "inbox", tmp_path / "progress"
    inbox.mkdir()
    (inbox / "a.json").write_text(json.dumps([{"id": "1"}]))
    for _ in range(2):
        ingest_stream(lake, "profiles", stream_json(lake, "profiles", str(inbox)), str(progress)).awaitTermination()
        for commit in (progress / "commits").iterdir():  # as if it had stopped before the batch was committed
            commit.unlink()
    assert lake.bronze("profiles").count() == 1
    [run] = lake.history("profiles").collect()
    assert (run["version"], run["rows"]) == (0, 1)


def test_old_publications_count(spark, tmp_path):
    schema = "id string, ownerId string, ownerUsername string, commentsCount long, likesCount long, data_hora timestamp_ntz"
    for number, day in enumerate((20, 25, 2, 26)):
        rows = [(str(number), "x", "x", 1, 1, datetime(2024, 1, day))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        write_changes(running_totals(stream), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    row = current_totals(spark, str(tmp_path / "out")).first()
    assert row["count"] == 4 and row["minData"] == datetime(2024, 1, 2)
    with pytest.raises(Exception, match="another query"):
        write_changes(running_totals(stream), str(tmp_path / "out"), str(tmp_path / "lost")).awaitTermination()


def test_running_totals_over_two_arrivals(spark, tmp_path):
    schema = ("id string, ownerId string, ownerUsername string, commentsCount long, likesCount long, "
              "data_hora timestamp_ntz, event_time timestamp")
    source = str(tmp_path / "in")

    def arrive(*rows):
        made = [(i, o, o, c, n, datetime(2024, 1, d), datetime(2024, 1, d)) for i, o, c, n, d in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        write_changes(running_totals(stream), str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
        return {r["ownerId"]: r for r in current_totals(spark, str(tmp_path / "out")).collect()}

    first = arrive(("a", "x", 1, 10, 1), ("a", "x", 1, 10, 1), ("b", "y", 2, 20, 1))
    assert (first["x"]["count"], first["x"]["likesSum"], first["y"]["count"]) == (1, 10, 1)
    second = arrive(("c", "x", 5, 50, 2), ("a", "x", 1, 10, 1))
    assert (second["x"]["count"], second["x"]["commentsSum"], second["x"]["maxData"]) == (2, 6, datetime(2024, 1, 2))
    assert second["y"]["count"] == 1


def test_owners_without_a_key_are_left_out(spark, tmp_path):
    rows = spark.sql("""SELECT 'a' AS id, CAST(NULL AS string) AS ownerId, 'x' AS ownerUsername, 1L AS commentsCount,
        1L AS likesCount, timestamp_ntz'2024-01-01' AS data_hora, timestamp'2024-01-01' AS event_time""")
    rows.union(rows.withColumn("ownerId", F.lit("1")).withColumn("id", F.lit("b"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    write_changes(running_totals(stream), str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    assert current_totals(spark, str(tmp_path / "out")).count() == 1


def scrapes(spark, tmp_path, **days):
    """A function that stores scrapes (id, owner, comments, likes, day, scraped day), runs the stream once more, and sums up."""
    schema = ("id string, ownerId string, ownerUsername string, commentsCount long, likesCount long, data_hora timestamp_ntz, "
              "scraped timestamp")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*rows):
        made = [(i, o, o, c, n, datetime(2024, 1, d), datetime(2024, 2, s)) for i, o, c, n, d, s in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        running = write_changes(running_changes(stream, **days), out, str(tmp_path / "progress"))
        running.awaitTermination()
        totals = {r["ownerId"]: (r["commentsSum"], r["likesSum"], r["count"], r["corrected"]) for r in summed_changes(spark, out).collect()}
        return totals, running.lastProgress["stateOperators"][0]["numRowsTotal"]

    return arrive


def test_later_scrapes_correct_the_totals_over_restarts(spark, tmp_path):
    arrive = scrapes(spark, tmp_path)
    totals, _ = arrive(("a", "x", 1, 10, 5, 1), ("b", "x", 2, 20, 6, 1), ("c", "y", 3, 30, 7, 1), ("a", "x", 1, 10, 5, 1))
    assert totals == {"x": (3, 30, 2, 0), "y": (3, 30, 1, 0)}
    # A new scrape, the same again, an older one that comes late, and one publication more.
    totals, _ = arrive(("a", "x", 4, 15, 5, 3), ("c", "y", 3, 30, 7, 3), ("b", "x", 0, 1, 6, 0 + 1), ("d", "x", 1, 1, 1, 2))
    assert totals == {"x": (7, 36, 3, 1), "y": (3, 30, 1, 0)}
    totals, _ = arrive(("a", "x", 9, 99, 5, 2))  # older than the scrape that is known
    assert totals["x"] == (7, 36, 3, 1)
    row = summed_changes(spark, str(tmp_path / "out")).where("ownerId = 'x'").first()
    assert (row["minData"], row["maxData"]) == (datetime(2024, 1, 1), datetime(2024, 1, 6))


def test_state_is_forgotten(spark, tmp_path):
    arrive = scrapes(spark, tmp_path, keep_days=1e-8, idle_days=1e-8)
    arrive(*[(f"p{i}", f"o{i % 3}", 1, 1, 1, 1) for i in range(12)])
    totals, left = arrive(("new", "o9", 1, 1, 1, 2))
    totals, left = arrive(("newer", "o9", 1, 1, 1, 2))
    assert left < 12 and sum(t[2] for t in totals.values()) == 14


class States:
    """Map, value and timer state of one owner in memory; counts the calls."""

    def __init__(self):
        self.map, self.value, self.calls = {}, None, 0

    def called(self, result=None):
        self.calls += 1
        return result

    def getMapState(self, *_):
        return SimpleNamespace(getValue=lambda k: self.called(self.map.get(k)), containsKey=lambda k: self.called(k in self.map),
                               updateValue=lambda k, v: self.called(self.map.update({k: v})), clear=lambda: self.called(self.map.clear()))

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.called(self.value), update=lambda v: self.called(setattr(self, "value", v)))

    def listTimers(self):
        return iter(self.called([]))

    def registerTimer(self, at):
        self.called()


def test_corrections_call_the_state_store_per_page(monkeypatch):
    """Against a plain second computation, with pages that split and publications that are forgotten one by one."""
    rng, states, known = random.Random(3), States(), {}
    operator = running.Publications(50, 1000)
    operator.init(states)
    monkeypatch.setattr(running, "PAGE", 8, raising=False)
    for now in range(0, 200, 10):
        rows = [Row(id=f"p{rng.randrange(300)}", commentsCount=rng.randrange(3), likesCount=rng.choice([None, 1, 2]), data_hora=datetime(2024, 1, 1),
                    scraped=now + rng.randrange(20)) for _ in range(120)]
        want = [0, 0, 0, 0]
        for row in sorted(rows, key=lambda r: (r.id, r.scraped)):
            old = known.get(row.id)
            old = old if old and old[3] + 50 > now else None
            if old and old[2] >= row.scraped:
                continue
            new = (row.commentsCount, row.likesCount or 0, row.scraped, now)
            for i, change in enumerate((new[0] - (old[0] if old else 0), new[1] - (old[1] if old else 0), not old, bool(old and old[:2] != new[:2]))):
                want[i] += change
            known[row.id] = new
        got = list(operator.handleInputRows(("o", "o"), iter(rows), SimpleNamespace(getCurrentProcessingTimeInMs=lambda now=now: now)))
        assert [(r["commentsSum"], r["likesSum"], r["count"], r["corrected"]) for r in got] == [tuple(want)]
    assert len(states.map) > 16 and states.value[1] <= 8 * states.value[0]
    states, rows = States(), [Row(id=f"p{i}", commentsCount=1, likesCount=1, data_hora=None, scraped=s) for i in range(1000) for s in (1, 2)]
    operator.init(states)
    monkeypatch.setattr(running, "PAGE", 256, raising=False)
    list(operator.handleInputRows(("o", "o"), iter(rows), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1)))
    assert states.calls < 50
