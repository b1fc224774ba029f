"""State per key that ends by itself: events carried over, articles kept for a time, feeds polled on conditions.

Each is a stateful processor under ``transformWithState``: value state in RocksDB, ended by event-time timers, so that
what a stream gives follows from its rows and not from when it runs. ``needs_rocksdb`` sets up a session for them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.http import fetch

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = dt.datetime(1970, 1, 1)


def needs_rocksdb(spark: SparkSession) -> None:
    """Have the session's streams keep their state in RocksDB, which ``transformWithState`` asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _millis(at: dt.datetime) -> int:
    return round((at.replace(tzinfo=None) - _EPOCH).total_seconds() * 1000)


def _time(millis: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(milliseconds=millis)


class _CarryOver(StatefulProcessor):
    """An event is given as it comes, and again at each report time until ``keep`` milliseconds after its own time."""

    def __init__(self, every: int, keep: int):
        self.every, self.keep = every, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", "at long, title string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(((_millis(r["at"]), r["title"] or "") for r in rows), key=lambda r: r)
        if self.event.exists():
            newest = max(newest, tuple(self.event.get()))
        else:
            self.handle.registerTimer((newest[0] // self.every + 1) * self.every)
        self.event.update(newest)
        yield Row(url=key[0], at=_time(newest[0]), title=newest[1], as_of=_time(newest[0]), carried=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, title = self.event.get()
        report, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        while report <= min(now, at + self.keep):  # a watermark may pass several report times at once
            if report > at:
                yield Row(url=key[0], at=_time(at), title=title, as_of=_time(report), carried=True)
            report += self.every
        if report > at + self.keep:
            self.event.clear()
        else:
            self.handle.registerTimer(report)

    def close(self) -> None:
        pass


def carried_over(events: DataFrame, every: str = "12 hours", keep: str = "7 days", late: str = "1 day") -> DataFrame:
    """(url, at, title, as_of, carried): ``events`` (url, at, title) as they come, and once more for each report time,
    a multiple of ``every``, up to ``keep`` after them. Of several rows of an address the newest counts, then the greater
    title. Rows without an address or a time go."""
    ms = lambda span: int(_interval(span).total_seconds() * 1000)
    rows = events.where("url is not null and at is not null").select("url", "at", "title").withWatermark("at", late)
    schema = "url string, at timestamp_ntz, title string, as_of timestamp_ntz, carried boolean"
    out = rows.groupBy("url").transformWithState(_CarryOver(ms(every), ms(keep)), schema, "append", "EventTime")
    return out.select("url", F.col("at").cast("timestamp").alias("at"), "title", F.col("as_of").cast("timestamp").alias("as_of"), "carried")


class _Retention(StatefulProcessor):
    """A key is known from its first row until ``keep`` milliseconds after that row's time."""

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at = min(_millis(r["at"]) for r in rows)
        if not self.first.exists():
            self.first.update((at,))
            self.handle.registerTimer(at + self.keep)
            yield Row(url=key[0], at=_time(at), gone=False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield Row(url=key[0], at=_time(expiredTimerInfo.getExpiryTimeInMs()), gone=True)
        self.first.clear()

    def close(self) -> None:
        pass


def retained(articles: DataFrame, keep: str = "45 days", late: str = "7 days") -> DataFrame:
    """(url, at, gone): each address as it is first seen, and again, gone, once ``keep`` has passed since; after that it
    may enter anew. What a sink holds is each address's last row, if not gone."""
    rows = articles.where("url is not null and at is not null").select("url", "at").withWatermark("at", late)
    processor = _Retention(int(_interval(keep).total_seconds() * 1000))
    out = rows.groupBy("url").transformWithState(processor, "url string, at timestamp_ntz, gone boolean", "append", "EventTime")
    return out.select("url", F.col("at").cast("timestamp").alias("at"), "gone")


def _interval(span: str) -> dt.timedelta:
    """A span such as "7 days" or "12 hours"."""
    n, unit = span.split()
    return dt.timedelta(**{unit if unit.endswith("s") else unit + "s": float(n)})


class _Poll(StatefulProcessor):
    """A feed's tags, failures in a row and pause; a tick reads the feed unless it is paused."""

    def __init__(self, timeout: float, get=fetch):
        self.timeout, self.get = timeout, get

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("feed", "etag string, modified string, errors int, pause long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        etag, modified, errors, pause = self.known.get() if self.known.exists() else (None, None, 0, 0)
        for at in sorted(_millis(r["at"]) for r in rows):
            if at < pause:
                yield Row(feed=key[0], at=_time(at), status=None, errors=errors, retry_after=_time(pause), body=None)
                continue
            status, body, e, m = self.get(key[0], self.timeout, etag, modified)
            errors = 0 if status == 304 or status == 200 and body else errors + 1
            hours = min(48, 6 * 2 ** (errors - 3)) if errors >= 3 else 0
            pause = at + hours * 3_600_000 if hours else 0
            if not errors:
                etag, modified = e or etag, m or modified
            yield Row(feed=key[0], at=_time(at), status=status, errors=errors, retry_after=_time(pause) if pause else None, body=body if status == 200 else None)
        self.known.update((etag, modified, errors, pause))

    def close(self) -> None:
        pass


def polled(ticks: DataFrame, timeout: float = 15.0, get=fetch) -> DataFrame:
    """(feed, at, status, errors, retry_after, body) for each of ``ticks`` (feed, at): the feed is read with the tags of
    its last good read, so an unchanged one answers 304; a good or unchanged read resets its failures, and from the third
    in a row on it pauses 6, 12, 24, at most 48 hours. A paused feed isn't read and has no status.

    Feeds are dealt to executors by key, and their tags are state of the query: a batch that is run again after a lost
    executor reads with the tags as of before it, and so misses nothing.
    """
    schema = "feed string, at timestamp_ntz, status int, errors int, retry_after timestamp_ntz, body binary"
    out = ticks.where("feed is not null and at is not null").groupBy("feed").transformWithState(_Poll(timeout, get), schema, "append", "None")
    return out.select("feed", F.col("at").cast("timestamp").alias("at"), "status", "errors", F.col("retry_after").cast("timestamp").alias("retry_after"), "body")


class _Backoff(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.errors = handle.getValueState("errors", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        errors = self.errors.get()[0] if self.errors.exists() else 0
        for at, ok in sorted((_millis(r["at"]), r["ok"]) for r in rows):
            errors = 0 if ok else errors + 1
            wait = min(48, 6 * 2 ** (errors - 3)) if errors >= 3 else 0
            yield Row(feed=key[0], at=_time(at), errors=errors, retry_after=_time(at + wait * 3_600_000) if wait else None)
        self.errors.update((errors,))

    def close(self) -> None:
        pass


def feed_states(polls: DataFrame) -> DataFrame:
    """Running state per feed from polls (feed, at, ok): failures in a row and the time of the next poll."""
    schema = "feed string, at timestamp_ntz, errors int, retry_after timestamp_ntz"
    out = polls.where("feed is not null and at is not null").groupBy("feed").transformWithState(_Backoff(), schema, "append", "None")
    return out.select("feed", F.col("at").cast("timestamp").alias("at"), "errors", F.col("retry_after").cast("timestamp").alias("retry_after"))
