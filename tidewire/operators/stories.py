"""Stories: representatives, themes, scores, classes and their documents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions import fixed_values as fixed
from ..functions import patterns, vectors
from .graph import cut


def representative_bonus(r: dict[str, Column], has_domestic: Column) -> Column:
    """What makes an article speak for its story besides being near its centre."""
    url = F.coalesce(r["url"], F.lit(""))
    return (
        F.when(r["syndicated_of"].isNotNull(), -0.12).otherwise(0.0)
        + F.when(F.coalesce(r["title"], F.lit("")).rlike(fixed.OPINION), -0.15).otherwise(0.0)
        + F.when(has_domestic & (r["scope"] == "domestic"), 0.06).when(has_domestic & (r["scope"] == "abroad_local"), 0.03).otherwise(0.0)
        + F.when(r["kind"].isin("official", "paper", "media", "broadcast", "wire"), 0.04).when(r["kind"].isin("aggregator", "portal"), -0.05).otherwise(0.0)
        + F.when(r["factuality"].isin("very_high", "high"), 0.04).when(r["factuality"] == "mixed", -0.04).otherwise(0.0)
        + F.when(~F.startswith(r["source_id"], F.lit("gn:")) & ~F.startswith(url, F.lit("https://news.google.com/")), 0.03).otherwise(0.0)
    )


def representatives(members: DataFrame) -> DataFrame:
    """(story_id, id, pick) of the best article per story; ``members`` has sim to the centre and the article's columns."""
    domestic = F.max(F.col("scope") == "domestic").over(Window.partitionBy("story_id"))
    cols = {c: F.col(c) for c in ("url", "syndicated_of", "title", "scope", "kind", "factuality", "source_id")}
    rows = members.withColumn("__d", domestic).withColumn("pick", F.col("sim") + representative_bonus(cols, F.col("__d")))
    return rows.groupBy("story_id").agg(F.max_by(F.struct("id", "pick"), F.struct(F.round("pick", 9), -F.col("id"))).alias("b")).select("story_id", "b.id", "b.pick")


def coverage(members: DataFrame, now: str) -> DataFrame:
    """Per story of its core rows (similarity 0.93 or more): articles, independent, scopes, recent, growing and volume figures."""
    core = members.where(F.coalesce("similarity", F.lit(1.0)) >= 0.93)
    recent = F.col("at") >= F.expr(f"timestamp '{now}' - interval 24 hours")
    return core.groupBy("story_id").agg(
        F.count("*").alias("articles"),
        F.greatest(F.lit(1), F.count_distinct(F.when(F.col("syndicated_of").isNull(), F.col("source_id")))).alias("independent"),
        F.count_distinct("scope").alias("scopes"),
        F.count_if(recent).alias("last_24h"),
        *(F.count_if(F.col("scope") == s).alias(s) for s in ("domestic", "abroad_local", "international")),
        F.min("at").alias("first_seen"), F.max("at").alias("last_seen"),
        F.max(F.col("kind") == "official").alias("official"),
    )


def scores(stories: DataFrame) -> DataFrame:
    """``coverage`` rows with policy and themes, and their score: breadth of coverage, weighed by policy, elections first."""
    n = F.col("independent")
    consensus = F.when(n >= 5, 2.0 + 0.5 * (n - 5)).when(n >= 3, 1.0).otherwise(0.0)
    growing = F.when(F.col("last_24h") / F.col("articles") >= 0.4, 1.0).otherwise(0.0)
    breadth = n + consensus + 0.5 * (F.col("scopes") - 1) + growing + 0.2 * F.log2("articles")
    policy = F.coalesce("policy", F.lit(0.3))
    score = breadth * (0.6 + 0.5 * policy) + 1.2 * policy + F.when(patterns.is_election(F.col("themes")), 2.5).otherwise(0.0)
    return stories.withColumn("score", F.round(score, 2))


def keyword_share(members: DataFrame, keywords: list[str], out: str = "share") -> DataFrame:
    """Per story the share of articles with a keyword: 1 in the title, 0.3 in the lead only."""
    p = patterns.keyword_regex(keywords)
    hit = F.when(F.lower("title").rlike(p), 1.0).when(F.lower(F.coalesce("lead", F.lit(""))).rlike(p), 0.3).otherwise(0.0)
    return members.groupBy("story_id").agg(F.avg(hit).alias(out))


#: Themes that stay on a story that reads like a crime or an accident, and those that need keywords.
ALWAYS = ["anticorruption", "security", "defence_industry", "diplomacy", "elections", "unrest_conflict", "sectarian_conflict"]
STRICT = ["elections", "unrest_conflict", "sectarian_conflict"]


def theme_tags(signals: DataFrame, default: float = 0.3) -> DataFrame:
    """Per story policy and themes from (story_id, theme, label, weight, low, share, z)."""
    tagged = signals.where((F.col("share") >= 0.4) | (~F.col("theme").isin(STRICT) & (F.col("z") >= 4.0)))
    lowish = F.max(F.col("low") & (F.col("share") >= 0.4)).over(Window.partitionBy("story_id"))
    tagged = tagged.withColumn("__l", lowish).where(~F.col("__l") | F.col("low") | F.col("theme").isin(ALWAYS))
    high = F.max(F.when(~F.col("low"), F.col("weight")))
    per = tagged.groupBy("story_id").agg(high.alias("high"), F.min(F.when(F.col("low"), F.col("weight"))).alias("least"), F.sort_array(F.collect_list(F.struct("low", "label"))).alias("t"))
    shown = F.transform(F.filter("t", lambda t: ~t["low"] | F.col("high").isNull()), lambda t: t["label"])
    every = signals.select("story_id").distinct().join(per, "story_id", "left")
    return every.select("story_id", F.coalesce("high", "least", F.lit(default)).alias("policy"), F.coalesce(shown, F.array().cast("array<string>")).alias("themes"))


def z_scores(df: DataFrame, value: str, by: list[str], out: str = "z") -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(out, (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + 1e-9))


def nearest(queries: DataFrame, prototypes: DataFrame, least: float, other: str = "other") -> DataFrame:
    """(id, label, sim): the closest prototype of each vector, or ``other`` below ``least``; prototypes are few."""
    pairs = queries.crossJoin(F.broadcast(prototypes)).withColumn("sim", vectors.dot("vector", "prototype"))
    best = pairs.groupBy("id").agg(F.max_by(F.struct("label", "sim"), F.struct(F.round("sim", 9), F.col("label"))).alias("b"))
    return best.select("id", F.when(F.col("b.sim") >= least, F.col("b.label").cast("string")).otherwise(other).alias("label"), F.col("b.sim").alias("sim"))


def collapse_elections(stories: DataFrame, most: int = 5) -> DataFrame:
    """One election story per country, with the next ``most`` nested and the count of all; other stories as they are."""
    rows = stories.withColumn("__e", patterns.is_election(F.col("themes")))
    order = [F.desc("independent"), F.desc("score"), F.desc("last_24h"), F.asc("id")]
    w = Window.partitionBy("country", "__e").orderBy(*order)
    rows = rows.withColumn("__rn", F.row_number().over(w))
    nested = rows.where(F.col("__e") & (F.col("__rn") <= most + 1)).groupBy("country").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("__rn") > 1, F.struct("__rn", "id")))), lambda s: s["id"]).alias("nested")
    )
    counts = rows.where("__e").groupBy("country").agg(F.count("*").alias("n_elections"))
    lead = rows.where("not __e or __rn = 1").join(nested, "country", "left").join(counts, "country", "left")
    only = lambda c: F.when(F.col("__e"), F.col(c))
    return lead.select(*stories.columns, only("n_elections").alias("n_elections"), only("nested").alias("nested"))


def log2(x: Column) -> Column:
    """Base-2 logarithm to the last bit as the C library has it. Spark's is a quotient of two rounded logarithms, so sums that
    are equal but for their last bit come in another order."""
    return _log2(x.cast("double"))


@F.pandas_udf(T.DoubleType())
def _log2(x: pd.Series) -> pd.Series:
    return x.map(math.log2)


def breadth(stories: DataFrame, scale: Column) -> DataFrame:
    """Outlet breadth and speed relative to how many outlets a desk knows."""
    n, s = F.col("independent"), scale
    kinds = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in ("domestic", "abroad_local", "international")), F.lit(0))
    core = F.least(n, s) / s + 0.12 * log2(1 + F.greatest(F.lit(0.0), n - s))
    wide = core + F.when(F.col("domestic") >= 2, 0.12).otherwise(0.0) + F.when(kinds >= 2, 0.08).otherwise(0.0)
    day = F.least(n.cast("double"), F.col("last_24h") * n / F.greatest(F.lit(1), F.col("articles")))
    fast = F.least(day, s.cast("double")) / s + 0.12 * log2(1 + F.greatest(F.lit(0.0), day - s))
    return stories.withColumn("breadth", wide).withColumn("velocity", fast)


#: Rows and centres that meet in one task.
ROW_BLOCK, CENTRE_BLOCK = 4096, 1024


def nearest_centres(rows: DataFrame, centres: DataFrame, by: str = "country") -> DataFrame:
    """(id, story_id, sim): of each row (id, ``by``, vector) the nearest centre (story_id, ``by``, centre) of its group.

    Rows and centres of a group are dealt to blocks; a pair of blocks is one matrix product in one task, of which a row a
    row is left. Nothing is broadcast, and a group of any size is many tasks. Unit vectors; rows and centres without a
    vector go; similarities count to nine digits, equal ones go to the smaller story.
    """
    r = rows.where("vector is not null").select("id", F.col(by).alias("g"), F.col("vector").cast("array<double>").alias("v"))
    c = centres.where("centre is not null").select("story_id", F.col(by).alias("g"), F.col("centre").cast("array<double>").alias("c"))
    blocks = lambda d, n, name: d.groupBy("g").agg(F.ceil(F.count("*") / n).alias(name))
    sizes = cut(blocks(r, ROW_BLOCK, "rows").join(blocks(c, CENTRE_BLOCK, "centres"), "g"))
    deal = lambda d, key, own, other, i, j: d.join(sizes, "g").withColumn(i, F.pmod(F.xxhash64(key), F.col(own))).withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("rows", "centres")
    r, c = deal(r, "id", "rows", "centres", "i", "j"), deal(c, "story_id", "centres", "rows", "j", "i")
    kinds = {n: d.schema[n].dataType for d, n in ((rows, "id"), (centres, "story_id"))}
    arrow = {n: to_arrow_type(k) for n, k in kinds.items()}

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({"id": pa.array([], arrow["id"]), "story_id": pa.array([], arrow["story_id"]), "sim": pa.array([], pa.float64())})
        b = b.sort_by("story_id")
        sim = np.array(a.column("v").to_pylist()) @ np.array(b.column("c").to_pylist()).T
        best = np.round(sim, 9).argmax(1)  # the first of equals
        return pa.table({"id": a.column("id"), "story_id": b.column("story_id").take(pa.array(best)), "sim": pa.array(sim[np.arange(len(best)), best])})

    keys = ["g", "i", "j"]
    met = r.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(compare, f"id {kinds['id'].simpleString()}, story_id {kinds['story_id'].simpleString()}, sim double")
    best = met.groupBy("id").agg(F.min_by(F.struct("story_id", "sim"), F.struct(-F.round("sim", 9), "story_id")).alias("b"))
    return best.select("id", "b.story_id", "b.sim")
