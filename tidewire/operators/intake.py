"""What decides whether a feed is read, an item enters, and whom an event concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import terms, text
from .graph import cut, small


def due_feeds(feeds: DataFrame, now: Column) -> DataFrame:
    """Feeds that may be read: those without a pause, or whose pause is over."""
    return feeds.where(F.col("retry_after").isNull() | (F.col("retry_after") <= now))


def with_link(items: DataFrame) -> DataFrame:
    """Items that have an address and a title."""
    some = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) > 0
    return items.where(some(F.col("url")) & some(F.col("title")))


def mentioned(items: DataFrame, mentions: DataFrame) -> DataFrame:
    """Items of international sources only where title or lead match the country's pattern (``mentions``: country, pattern)."""
    told = F.concat_ws(" ", "title", "lead")
    own = mentions.groupBy("country").agg(F.collect_list("pattern").alias("__patterns"))  # a row a country, so no item comes twice
    rows = items.join(own, "country", "left")
    hit = F.exists("__patterns", lambda p: F.regexp_like(told, p))
    return rows.where((F.col("scope") != "international") | F.coalesce(hit, F.lit(False))).drop("__patterns")


def source_of(events: DataFrame, sources: DataFrame, prefix: str = "gdelt:") -> DataFrame:
    """``events`` (id, country, url) with source_id: the first source (by ``place``) of the country with the address's domain,
    else the domain under ``prefix``. Events without a domain go."""
    known = sources.select("country", text.domain("homepage").alias("domain"), F.struct("place", "id").alias("s"))
    known = known.groupBy("country", "domain").agg(F.min("s").alias("s"))
    rows = events.withColumn("domain", text.domain("url")).where("domain <> ''").join(known, ["country", "domain"], "left")
    return rows.withColumn("source_id", F.coalesce("s.id", F.concat(F.lit(prefix), "domain"))).drop("s")


#: Fixed value: an organisation whose name has a neighbour's; its titles concern that desk only if they name it otherwise.
ELSEWHERE = ("lebanon", "kataib hezbollah", ("lebanon", "beirut"))


def desks_of(events: DataFrame, desks: DataFrame) -> DataFrame:
    """(id, desk): every desk whose names the title has, or whose names the place has and any of whose terms the title has.

    ``desks``: desk, names and terms, arrays of terms of one or more words (names are terms as well). One automaton finds
    the terms of all desks in a text (``functions.terms``), so no event meets a desk that it doesn't name.
    """
    flat = lambda c, kind: desks.select("desk", F.explode(c).alias("term")).distinct().withColumn("kind", F.lit(kind))
    catalog = cut(flat("names", "name").unionByName(flat("terms", "term")).withColumn("number", F.monotonically_increasing_id()))
    texts = events.select("id", F.explode(F.array(F.struct(F.lit("title").alias("where"), F.col("title").alias("text")), F.struct(F.lit("place").alias("where"), F.col("place").alias("text")))).alias("x"))
    texts = texts.select(F.struct("id", F.col("x.where").alias("where")).alias("at"), F.col("x.text").alias("text"))
    desk, but, unless = ELSEWHERE
    low = F.lower("text")
    texts = texts.withColumn("not_here", F.coalesce(F.contains(low, F.lit(but)) & ~F.contains(low, F.lit(unless[0])) & ~F.contains(low, F.lit(unless[1])), F.lit(False)))
    texts = texts.select(F.struct("at.id", "at.where", "not_here").alias("at"), "text")
    met = terms.found_terms(texts, catalog, "at").join(small(catalog.select("number", "desk", "kind")), "number")
    met = met.where(~((F.lower("desk") == desk) & F.col("at.not_here") & (F.col("kind") == "name")))
    at = lambda where, *kinds: F.max((F.col("at.where") == where) & F.col("kind").isin(*kinds))
    told = met.groupBy("at.id", "desk").agg(at("title", "name").alias("named"), at("title", "name", "term").alias("told"), at("place", "name").alias("here"))
    return told.where("named or here and told").select("id", "desk")


def candidates(events: DataFrame, most: int = 55) -> DataFrame:
    """The ``most`` events to look into: of a known country first, then of the gravest kinds, then the newest days."""
    order = [F.desc("known"), F.desc(F.col("kind").isin("19", "20")), F.desc(F.to_date("at")), F.asc("id")]
    return events.orderBy(*order).limit(most)


def best_posts(posts: DataFrame, most: int = 6) -> DataFrame:
    """Per country the ``most`` posts by keyword hit, weight and nearness."""
    w = Window.partitionBy("country").orderBy(F.desc("hit"), F.desc("weight"), F.desc("sim"), F.asc("id"))
    return posts.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)


def fan_out(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows once for each owner of their ``key``, whatever its letter case (``owners``: key, desk)."""
    return rows.join(owners.select(F.lower(key).alias("__k"), "desk").distinct(), F.lower(key) == F.col("__k")).drop("__k")


def event_items(entries: DataFrame) -> DataFrame:
    """Feed entries (kind, title, summary, url, level, at) as events: advice of one kind has its note in the summary,
    which then becomes the title."""
    swap = (F.col("kind") == "UK travel advice") & (F.coalesce("summary", F.lit("")) != "")
    title = F.when(swap, F.col("summary")).otherwise(text.squash("title"))
    return entries.select("id", "kind", title.alias("title"), F.when(swap, "").otherwise(F.col("summary")).alias("summary"), "url", "level", "at")


def pool(parts: DataFrame, order: list[Column]) -> DataFrame:
    """Stories of several lists, each once: by address, else by title and country, else by id; the first by ``order`` stays."""
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    key = F.coalesce(given("url"), F.concat(given("title"), F.lit("|"), F.coalesce("country", F.lit(""))), F.col("id").cast("string"))
    w = Window.partitionBy("__key").orderBy(*order)
    return parts.withColumn("__key", key).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__key", "__rn")


def industry(stories: DataFrame, theme: str) -> DataFrame:
    """Stories of a theme; all of them where none has it."""
    has = F.array_contains("themes", theme)
    any_ = stories.agg(F.coalesce(F.max(has), F.lit(False)).alias("__any"))  # one row
    return stories.crossJoin(F.broadcast(any_)).where(has | ~F.col("__any")).drop("__any")


def keep_old(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with ``new`` merged in by ``key``: an old value stays unless it is null."""
    names = [c for c in old.columns if c != key]
    n = new.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in names))
    joined = old.join(n, F.col(key) == F.col("__k"), "full_outer")
    return joined.select(F.coalesce(key, "__k").alias(key), *(F.coalesce(c, f"__{c}").alias(c) for c in names))


def replace(old: DataFrame, new: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``old`` with its rows of ``new``'s keys replaced; of several new rows of a key the last by ``order`` counts."""
    w = Window.partitionBy(key).orderBy(*order)
    last = new.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select(*old.columns)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


#: How the directory of desks can be sorted.
DIRECTORY = {
    "attention": ["alerts", "elections", "surging", "stories_24h", "stories_7d"],
    "24h": ["stories_24h", "stories_7d"],
    "7d": ["stories_7d", "stories_24h"],
    "az": [],
}


def directory(desks: DataFrame, by: str) -> DataFrame:
    """Desks with their place under a sort order of ``DIRECTORY``; names decide between equals. A row a desk, so one task."""
    return desks.withColumn("place", F.row_number().over(Window.orderBy(*(F.desc(F.coalesce(c, F.lit(0))) for c in DIRECTORY[by]), F.asc("name"))))


def policy_counts(stories: DataFrame) -> DataFrame:
    """Per country and window: stories, those of high (0.8 or more) and of low (0.2 or less) policy."""
    return stories.groupBy("country", "window_days").agg(
        F.count("*").alias("total"), F.count_if(F.col("policy") >= 0.8).alias("high"), F.count_if(F.col("policy") <= 0.2).alias("low")
    )


def tab_counts(stories: DataFrame, column: str, labels: list[str]) -> DataFrame:
    """(label, n) for "all" and every label, 0 where no story has it."""
    every = stories.sparkSession.createDataFrame([("all",), *((x,) for x in labels)], "label string")
    counts = stories.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).alias("whole"))
    counts = counts.select(F.when(F.col("whole") == 1, "all").otherwise(F.col(column)).alias("label"), "n")
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
