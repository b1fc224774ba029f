"""Streams with state: late rows, restarts, state that ends, feeds that are read on conditions."""

import datetime as dt
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tidewire import streaming
from tidewire.operators import delta

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    streaming.needs_rocksdb(spark)
    yield spark
    spark.conf.set(name, before)


def drain(df, tmp_path, name, mode="append"):
    """Runs a stream over what is there; all rows it has given so far, with their batch."""

    def keep(rows, batch):
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(str(tmp_path / name / f"batch={batch}"))

    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(str(tmp_path / name)).collect()


def source(spark, schema, folder):
    folder.mkdir()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_story_deltas_with_late_rows(spark, tmp_path):
    schema = "story_id long, at timestamp, similarity double, scope string, state_outlet boolean"
    rows = [(k % 3, T0 + dt.timedelta(hours=5 * k), 0.95 if k % 4 else 0.9, ("domestic", "international")[k % 5 == 0 and k > 60], k % 2 == 0) for k in range(130)]
    late = [rows[80], rows[85], rows[101]]  # come last, within the two days that are waited for
    first = [r for r in rows if r not in late]
    s = source(spark, schema, tmp_path / "in")
    put(spark, first, schema, tmp_path / "in")
    out = streaming.story_deltas(s, 7, "1 day", 12)
    before = drain(out, tmp_path, "deltas", "update")
    put(spark, late, schema, tmp_path / "in")
    got = {}
    for r in sorted(drain(out, tmp_path, "deltas", "update"), key=lambda r: r.batch):
        got[r.as_of, r.story_id] = tuple(r[c] for c in delta.STORY_DELTA)
    members = spark.createDataFrame(rows, schema)
    for now in (T0 + dt.timedelta(days=d) for d in (14, 21, 27)):
        want = {(now, r.story_id): tuple(r) for r in delta.story_deltas(members.where(F.col("at") < F.lit(now)), str(now), 7).collect()}
        assert want == {k: v for k, v in got.items() if k[0] == now}
    seen = {(r.as_of, r.story_id): tuple(r[c] for c in delta.STORY_DELTA) for r in before}
    moved = {k[0] for k in got if got[k] != seen.get(k)}
    t = late[0][1]
    assert any(t < m <= t + dt.timedelta(days=7) for m in moved) and any(t + dt.timedelta(days=7) < m <= t + dt.timedelta(days=14) for m in moved)  # as current and as previous row


def test_events_are_carried_until_their_day(rocksdb, tmp_path):
    spark, schema = rocksdb, "url string, at timestamp, title string"
    s = source(spark, schema, tmp_path / "in")
    out = streaming.carried_over(s, "1 day", "3 days", "1 hour")
    put(spark, [("a", T0 + dt.timedelta(hours=6), "one"), (None, T0, "x"), ("b", None, "x")], schema, tmp_path / "in")
    drain(out, tmp_path, "events")
    put(spark, [("c", T0 + dt.timedelta(days=2, hours=2), "later")], schema, tmp_path / "in")
    drain(out, tmp_path, "events")  # a new run goes on from the checkpoint
    put(spark, [("d", T0 + dt.timedelta(days=9), "last"), ("d", T0 + dt.timedelta(days=9), "lasu")], schema, tmp_path / "in")
    got = sorted((r.url, (r.as_of - T0).total_seconds() / 86400, r.title, r.carried) for r in drain(out, tmp_path, "events"))
    assert got == [("a", 0.25, "one", False), ("a", 1, "one", True), ("a", 2, "one", True), ("a", 3, "one", True),
                   ("c", 2 + 2 / 24, "later", False), ("c", 3, "later", True), ("c", 4, "later", True), ("c", 5, "later", True), ("d", 9, "lasu", False)]


def test_articles_go_after_their_time(rocksdb, tmp_path):
    spark, schema = rocksdb, "url string, at timestamp"
    s = source(spark, schema, tmp_path / "in")
    out = streaming.retained(s, "45 days", "1 day")
    day = lambda n: T0 + dt.timedelta(days=n)
    for rows in ([("a", day(0)), ("a", day(1))], [("a", day(20)), ("b", day(20))], [("c", day(50))], [("a", day(51)), ("b", day(52))]):
        put(spark, rows, schema, tmp_path / "in")
        got = drain(out, tmp_path, "kept")
    told = [(r.url, (r["at"] - T0).days, r.gone) for r in sorted(got, key=lambda r: (r.batch, r.url, r["at"]))]
    assert sorted(told) == [("a", 0, False), ("a", 45, True), ("a", 51, False), ("b", 20, False), ("c", 50, False)]


class _Feed(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        _Feed.asked.append((self.path, self.headers.get("If-None-Match")))
        good = self.path == "/good" or self.path == "/mends" and len([p for p, _ in _Feed.asked if p == "/mends"]) > 2
        if good and self.headers.get("If-None-Match") == '"v1"':
            self.send_response(304)
            self.end_headers()
        else:
            self.send_response(200 if good else 500)
            self.send_header("ETag", '"v1"' if good else '"bad"')
            self.end_headers()
            self.wfile.write(b"<rss/>" if good else b"")

    def log_message(self, *a):
        pass


def test_feeds_are_polled_on_conditions(rocksdb, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), _Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, spark, schema = f"http://127.0.0.1:{server.server_port}", rocksdb, "feed string, at timestamp"
    s = source(spark, schema, tmp_path / "in")
    out = streaming.polled(s, 5.0)
    feeds = [f"{base}/{n}" for n in ("good", "mends", "bad")]
    for hour in (0, 1, 2, 3, 9):
        put(spark, [(f, T0 + dt.timedelta(hours=hour)) for f in feeds], schema, tmp_path / "in")
        got = drain(out, tmp_path, "polls")  # each run restarts from the checkpoint
    server.shutdown()
    told = {f: [(r.status, r.errors, bool(r.body)) for r in sorted(got, key=lambda r: r["at"]) if r.feed == f] for f in feeds}
    assert told[feeds[0]] == [(200, 0, True), *[(304, 0, False)] * 4]
    assert told[feeds[1]] == [(500, 1, False), (500, 2, False), (200, 0, True), (304, 0, False), (304, 0, False)]
    assert told[feeds[2]] == [(500, 1, False), (500, 2, False), (500, 3, False), (None, 3, False), (500, 4, False)]  # paused from 2 to 8 o'clock
    assert len([p for p, _ in _Feed.asked if p == "/bad"]) == 4
    retry = [r.retry_after for r in sorted(got, key=lambda r: r["at"]) if r.feed == feeds[2]]
    assert retry[2] == T0 + dt.timedelta(hours=8) and retry[4] == T0 + dt.timedelta(hours=9 + 12)


def test_unique_titles_and_sliding_windows(spark, tmp_path):
    schema = "country string, title string, at timestamp"
    put(spark, [("hu", "A Title!", T0), ("hu", "a title", T0 + dt.timedelta(days=1)), ("de", "A title", T0)], schema, tmp_path / "t")
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "t"))
    assert sorted(r.country for r in drain(streaming.unique_titles(s), tmp_path, "titles")) == ["de", "hu"]
    schema = "ts timestamp, kind string, value double"
    put(spark, [(T0 + dt.timedelta(hours=h), "k", 1.0) for h in (0, 5, 13)], schema, tmp_path / "v")
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "v"))
    got = {(r.start - T0).total_seconds() / 3600: r.n for r in drain(streaming.volumes(s, "kind", "12 hours", "6 hours"), tmp_path, "volumes", "complete")}
    assert got == {-6: 2, 0: 2, 6: 1, 12: 1}


@pytest.mark.parametrize("name", ["story_deltas_stream", "volumes_stream"])
def test_tables_that_are_folders(spark, sf_dir, tmp_path, name):
    """Streams read a table of several files as they read a single file."""
    from tidewire.plans import named

    for t in ("documents", "events"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
    got, want = (named.QUERIES[name](spark, str(d)).collect() for d in (tmp_path, sf_dir))
    assert sorted(map(str, got)) == sorted(map(str, want)) != []
