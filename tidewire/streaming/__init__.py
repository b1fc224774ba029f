"""Continuous ingestion: idempotent articles, volumes, windows compared as they run; state that ends by itself is in ``keyed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import delta
from .keyed import carried_over, feed_states, needs_rocksdb, polled, retained

__all__ = ["backoff", "carried_over", "feed_states", "needs_rocksdb", "polled", "retained", "story_deltas", "unique_articles", "unique_titles", "volumes"]


def unique_articles(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Each canonical address once; undated items count as arriving now; later repeats within the watermark go."""
    rows = stream.withColumn("url", text.clean_url("url")).withColumn("at", F.coalesce("at", F.current_timestamp()))
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["url"])


def unique_titles(stream: DataFrame, late: str = "10 days") -> DataFrame:
    return stream.withColumn("key", text.title_key("title")).withWatermark("at", late).dropDuplicatesWithinWatermark(["country", "key"])


def volumes(stream: DataFrame, by: str, width: str = "1 day", slide: str | None = None, late: str = "7 days") -> DataFrame:
    """Events and their value per window and ``by``."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), by, "n", "value")


def backoff(errors: Column, now: Column) -> Column:
    """When a feed may be polled again: null below three errors in a row, then 6, 12, 24 and at most 48 hours later."""
    hours = F.least(F.lit(48), 6 * F.pow(F.lit(2), errors - 3)).cast("int")
    return F.when(errors >= 3, now + F.make_dt_interval(F.lit(0), hours))


def story_deltas(stream: DataFrame, days: int = 7, every: str | None = None, late_days: int = 2) -> DataFrame:
    """``delta.story_deltas`` as a stream runs: per ``as_of`` (the end of a window of ``days``, one each ``every``) and
    story the window compared with the one before it.

    ``stream``: story_id, at, similarity, scope, state_outlet. A row counts in the windows it lies in, and in those that
    begin where they end: it is sent twice, the second time moved on by a window, so that both counts of a comparison
    meet in one state and a late row corrects both. In update mode a comparison comes again when it changes.
    """
    copies = F.explode(F.array(F.struct(F.lit("curr").alias("p"), F.col("at").alias("t")), F.struct(F.lit("prev").alias("p"), (F.col("at") + F.make_dt_interval(F.lit(days))).alias("t"))))
    rows = stream.select("*", copies.alias("__x")).select("story_id", "similarity", "scope", "state_outlet", "__x.p", "__x.t")
    rows = rows.withWatermark("t", f"{days + late_days} days")  # copies are ahead of the rows by a window
    width = f"{days} days"
    return delta.compared(rows, ["story_id"], F.window("t", width, every or width).alias("window")).select(F.col("window.end").alias("as_of"), *delta.STORY_DELTA)
