"""Conditional HTTP reads as a batch data source: one partition per group of addresses, none waits for another."""

from __future__ import annotations

import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "url string, status int, etag string, last_modified string, body binary"


def fetch(url: str, timeout: float = 15.0, etag: str | None = None, last_modified: str | None = None) -> tuple[int, bytes, str | None, str | None]:
    """(status, body, etag, last_modified); status 0 means that no connection came about, 304 that nothing is new."""
    request = urllib.request.Request(url, headers={"User-Agent": "tidewire/1"})
    if etag:
        request.add_header("If-None-Match", etag)
    if last_modified:
        request.add_header("If-Modified-Since", last_modified)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read(), r.headers.get("ETag"), r.headers.get("Last-Modified")
    except urllib.error.HTTPError as e:
        return e.code, b"", e.headers.get("ETag") or etag, e.headers.get("Last-Modified") or last_modified
    except (urllib.error.URLError, OSError, ValueError):
        return 0, b"", etag, last_modified


class _Part(InputPartition):
    def __init__(self, urls: list[tuple[str, str | None, str | None]]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = [tuple((u.split("\t") + ["", ""])[:3]) for u in options.get("urls", "").split("\n") if u]
        self.timeout, self.pause = float(options.get("timeout", "15")), float(options.get("pause", "0"))
        self.parts = int(options.get("partitions", "20"))

    def partitions(self):
        return [_Part(self.urls[k :: self.parts]) for k in range(min(self.parts, len(self.urls)))]

    def read(self, partition):
        for url, etag, modified in partition.urls:
            status, body, e, m = fetch(url, self.timeout, etag or None, modified or None)
            if status in (0, 429):  # once more, after a moment
                time.sleep(max(self.pause, 0.05))
                status, body, e, m = fetch(url, self.timeout, etag or None, modified or None)
            yield url, status, e, m, body
            time.sleep(self.pause)


class HttpSource(DataSource):
    """``spark.dataSource.register(HttpSource)``, then ``spark.read.format("tidewire_http").option("urls", ...)``.

    ``urls``: one per line, each with its etag and modification time of the last read after tabs, if known.
    """

    @classmethod
    def name(cls):
        return "tidewire_http"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)
