"""Running engagement totals per owner."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from engagelake.operators.gold import with_metrics
from engagelake.sources.files import exists
from engagelake.streaming.ingest import query_id

TOTALS = ["commentsSum", "likesSum", "minData", "maxData", "count"]


def running_totals(stream: DataFrame, when: str = "event_time", lateness: str | None = None, key: str = "id") -> DataFrame:
    """Totals per owner over publications seen once each, however old they are when they arrive.

    The state holds every key seen. With a ``lateness`` it holds those inside the watermark only, and what is older
    when it arrives is left out (Spark counts such rows as dropped by the watermark in the progress of the query).
    """
    if lateness is None:
        unique = stream.dropDuplicates([key])
    else:
        unique = stream.withWatermark(when, lateness).dropDuplicatesWithinWatermark([key])
    return unique.where(F.col("ownerId").isNotNull() & F.col("ownerUsername").isNotNull()).groupBy(
        "ownerId", "ownerUsername"
    ).agg(
        F.coalesce(F.sum("commentsCount"), F.lit(0)).alias("commentsSum"),
        F.coalesce(F.sum("likesCount"), F.lit(0)).alias("likesSum"),
        F.min("data_hora").alias("minData"),
        F.max("data_hora").alias("maxData"),
        F.count(F.lit(1)).alias("count"),
    )


#: Publications a page of state may hold on average; its columns, in the order of their entries.
PAGE = 256
PAGE_SCHEMA = "id array<string>, comments array<long>, likes array<long>, scraped array<long>, at array<long>"


def page_of(id_: str, pages: int) -> int:
    return zlib.crc32(id_.encode()) % pages


class Publications(StatefulProcessor):
    """Changes of an owner's totals by publications that are new, or were scraped again with other counts.

    Per publication the last counts and the time of their scrape are kept, and forgotten when it has not been scraped for
    ``keep``; an owner who has been still for ``idle`` is forgotten as a whole. So the state holds what is current, and
    totals are the sum of all changes that came out, not state.

    The publications of an owner lie in pages by a digest of their ids, twice as many when they hold PAGE each: a call to the
    state store costs far more than the work on a row, and so one call reads or writes a page.
    """

    def __init__(self, keep_ms: int, idle_ms: int):
        self.keep_ms, self.idle_ms = keep_ms, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "page int", PAGE_SCHEMA, self.keep_ms)
        self.shape = handle.getValueState("shape", "pages int, held long")

    def _page(self, number: int, now: int) -> dict[str, tuple]:
        """id -> (comments, likes, scraped, time of the last change), without what is due to be forgotten."""
        value = self.seen.getValue((number,))
        return {i: entry for i, *entry in zip(*value, strict=True) if entry[3] + self.keep_ms > now} if value else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        comments = likes = fresh = corrected = 0
        first = last = None
        now = timerValues.getCurrentProcessingTimeInMs()
        shape = self.shape.get()
        pages, held = shape or (1, 0)
        loaded: dict[int, dict] = {}
        changed: set[int] = set()
        arrived = [(r.id, r.scraped, r.commentsCount or 0, r.likesCount or 0, r.data_hora) for r in rows]
        for id_, scraped, comments_now, likes_now, when in sorted(arrived, key=lambda r: r[:2]):
            number = page_of(id_, pages)
            if number not in loaded:
                loaded[number] = self._page(number, now)
            known = loaded[number].get(id_)
            if known and known[2] >= scraped:
                continue  # the same scrape again, or an older one that comes late
            comments, likes = comments + comments_now - (known[0] if known else 0), likes + likes_now - (known[1] if known else 0)
            fresh, corrected = fresh + (not known), corrected + bool(known and (known[0], known[1]) != (comments_now, likes_now))
            if when is not None and not known:
                first = min(first or when, when)
                last = max(last or when, when)
            loaded[number][id_] = (comments_now, likes_now, scraped, now)
            changed.add(number)
        held += fresh
        if held > PAGE * pages:
            every = {i: e for n in range(pages) for i, e in (loaded[n] if n in loaded else self._page(n, now)).items()}
            held = len(every)  # what has been forgotten does not count
            while held > PAGE // 2 * pages:
                pages *= 2
            loaded, changed = {n: {} for n in range(pages)}, set(range(pages))
            for id_, entry in every.items():
                loaded[page_of(id_, pages)][id_] = entry
        for number in changed:
            columns = zip(*((i, *e) for i, e in loaded[number].items()), strict=True)
            self.seen.updateValue((number,), tuple(map(list, columns)) or ([], [], [], [], []))
        if (pages, held) != shape:
            self.shape.update((pages, held))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle_ms)
        if fresh or corrected:
            yield Row(ownerId=key[0], ownerUsername=key[1], commentsSum=comments, likesSum=likes, minData=first, maxData=last,
                      count=fresh, corrected=corrected)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        self.shape.clear()
        return iter(())

    def close(self) -> None:
        pass


CHANGES = ("ownerId string, ownerUsername string, commentsSum long, likesSum long, minData timestamp_ntz, maxData timestamp_ntz, "
           "count long, corrected long")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def running_changes(stream: DataFrame, keep_days: float = 30, idle_days: float = 60) -> DataFrame:
    """Changes of the totals per owner, from (id, ownerId, ownerUsername, commentsCount, likesCount, data_hora, scraped).

    ``scraped`` (timestamp) tells which counts of a publication are newer: a later scrape corrects the totals by the
    difference, an earlier one that arrives late changes nothing. State is kept for publications scraped within
    ``keep_days`` and owners seen within ``idle_days`` of processing time; one that comes back later counts as new.
    """
    # What this operator needs: its state store; and no batches without data, which timers would ask for without an end
    # (what is due is forgotten with the next data).
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    usable = stream.where("ownerId is not null and ownerUsername is not null and id is not null and scraped is not null")
    rows = usable.select(F.col("id").cast("string").alias("id"), "ownerId", "ownerUsername", F.col("commentsCount").cast("long").alias("commentsCount"),
                         F.col("likesCount").cast("long").alias("likesCount"), F.col("data_hora").cast("timestamp_ntz").alias("data_hora"),
                         F.unix_micros(F.col("scraped").cast("timestamp")).alias("scraped"))
    processor = Publications(max(1, int(keep_days * DAY_MS)), max(1, int(idle_days * DAY_MS)))
    return rows.groupBy("ownerId", "ownerUsername").transformWithState(
        statefulProcessor=processor, outputStructType=CHANGES, outputMode="Update", timeMode="ProcessingTime")


def summed_changes(spark: SparkSession, path: str) -> DataFrame:
    """Totals per owner from all changes stored by ``write_changes``, and how many publications were corrected."""
    return spark.read.parquet(path).groupBy("ownerId", "ownerUsername").agg(
        F.sum("commentsSum").alias("commentsSum"), F.sum("likesSum").alias("likesSum"), F.min("minData").alias("minData"),
        F.max("maxData").alias("maxData"), F.sum("count").alias("count"), F.sum("corrected").alias("corrected"))


def write_changes(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store the owners each micro-batch changed as one partition, replaced when the batch is replayed.

    One folder belongs to one checkpoint; a query with another id refuses to write into it.
    """

    def write(batch: DataFrame, number: int) -> None:
        own = query_id(batch)
        if exists(batch.sparkSession, path):
            other = batch.sparkSession.read.parquet(path).where(F.col("_query") != own)
            if not other.isEmpty():
                raise ValueError(f"{path} holds the changes of another query: its checkpoint was lost, or two queries share it")
        (
            batch.withColumn("_query", F.lit(own)).withColumn("_batch", F.lit(number)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)
        )

    return (
        totals.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def running_gold(profiles: DataFrame, path: str) -> DataFrame:
    """Total, rate, recency and frequency per profile from the totals a stream has stored so far."""
    return with_metrics(profiles, current_totals(profiles.sparkSession, path))


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """The newest totals per owner; changes of one owner are reduced before the shuffle."""
    newest = F.max_by(F.struct(*TOTALS), F.col("_batch")).alias("t")
    return spark.read.parquet(path).groupBy("ownerId", "ownerUsername").agg(newest).select(
        "ownerId", "ownerUsername", "t.*"
    )
