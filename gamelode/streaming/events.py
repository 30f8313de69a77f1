"""Structured Streaming: event log, running state, counters, live index and review quality."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from gamelode.functions.text import clean_review

EVENT_SCHEMA = StructType([StructField("event_id", LongType()), StructField("user_id", LongType()), StructField("ts", TimestampType()), StructField("type", StringType()), StructField("appid", LongType()), StructField("query", StringType())])


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_log(events: DataFrame, apps: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Valid events once each within the watermark: queries trimmed, blank ones dropped, names of clicked games looked up."""
    clean = events.withColumn("query", F.nullif(F.trim("query"), F.lit(""))).filter("(type = 'search' and query is not null) or (type = 'click' and appid is not null)")
    once = clean.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else clean.dropDuplicates(["event_id"])
    return once.join(apps.select("appid", F.col("name").alias("game_name")), "appid", "left").withColumn("game_name", F.when(F.col("type") == "click", F.coalesce("game_name", F.lit("unknown game"))))


def running_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


STATE_OUT = "user_id bigint, place bigint, event_id bigint, ts timestamp, type string, appid bigint, query string, clicked array<bigint>"
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
StateRow = Row("user_id", "place", "event_id", "ts", "type", "appid", "query", "clicked")


class RecentActions(StatefulProcessor):
    """The newest actions of a user, ordered by event time: a late event takes its place, or is left out if older than all. The
    games that a user has clicked are kept beside them, with the time of the last click. With a lifetime (seconds of event
    time), actions and clicks older than that are forgotten when the watermark passes, by a timer of the user's oldest one.

    Each call of the state goes to the JVM and back, so both lists are read once and written once for a user and batch. Times are kept as microseconds."""

    def __init__(self, size: int = 10, lifetime: int | None = None):
        self.size, self.lifetime = size, lifetime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "event_id bigint, at bigint, type string, appid bigint, query string")
        self.clicked = handle.getListState("clicked", "appid bigint, at bigint")

    def _rows(self, user_id: Any, newest: list[tuple], clicked: dict[int, int]) -> Iterator[Row]:
        """The state as rows; one with a null place for a user of whom nothing is left."""
        games = sorted(clicked)
        for place, (event_id, at, *what) in enumerate(newest):
            yield StateRow(user_id, place, event_id, EPOCH + timedelta(microseconds=at), *what, games)
        if not newest:
            yield StateRow(user_id, None, None, None, None, None, None, games)

    def _wake_at_the_oldest(self, newest: list[tuple], clicked: dict[int, int]) -> None:
        if self.lifetime is None:
            return
        times = [r[1] for r in newest] + list(clicked.values())
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if times:
            self.handle.registerTimer(min(times) // 1000 + 1000 * self.lifetime)

    def _newest(self, known: dict[int, tuple]) -> list[tuple]:
        return sorted(known.values(), key=lambda r: (r[1], r[0]), reverse=True)[: self.size]

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        known = {r[0]: tuple(r) for r in self.recent.get()}
        clicked = {r[0]: r[1] for r in self.clicked.get()}
        before = dict(clicked)
        for r in rows:
            at = (r.ts.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1)
            known[r.event_id] = (r.event_id, at, r.type, r.appid, r.query)
            if r.type == "click" and r.appid is not None:
                clicked[r.appid] = max(at, clicked.get(r.appid, at))
            if len(known) > 100 * self.size:
                known = {n[0]: n for n in self._newest(known)}
        newest = self._newest(known)
        self.recent.put(newest)
        if clicked != before:
            self.clicked.put(list(clicked.items()))
        self._wake_at_the_oldest(newest, clicked)
        yield from self._rows(key[0], newest, clicked)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        until = 1000 * timerValues.getCurrentWatermarkInMs() - 1_000_000 * self.lifetime
        newest = [tuple(r) for r in self.recent.get() if r[1] > until]
        clicked = {r[0]: r[1] for r in self.clicked.get() if r[1] > until}
        for state, rows in ((self.recent, newest), (self.clicked, list(clicked.items()))):
            if rows:
                state.put(rows)
            else:
                state.clear()
        self._wake_at_the_oldest(newest, clicked)
        yield from self._rows(key[0], newest, clicked)

    def close(self) -> None:
        pass


def recent_state(events: DataFrame, size: int = 10, lifetime: int | None = None) -> DataFrame:
    """Every user's newest actions and clicked games after each batch. Needs the RocksDB state store. lifetime: seconds of event
    time after which they are forgotten; events then need a watermark on ts, and the session the time zone UTC."""
    return events.groupBy("user_id").transformWithState(RecentActions(size, lifetime), STATE_OUT, "Update", "none" if lifetime is None else "EventTime")


def stream_quality(reviews: DataFrame, delay: str = "1 hour") -> DataFrame:
    """English reviews, cleaned, not empty, once by id within the watermark."""
    good = reviews.filter(F.lower(F.trim("language")) == "english").withColumn("clean", clean_review("review_text")).filter("clean <> ''")
    return good.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["recommendationid"]) if reviews.isStreaming else good.dropDuplicates(["recommendationid"])
