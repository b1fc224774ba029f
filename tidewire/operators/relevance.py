"""Which articles are about a country: a cascade of section, scope and mention rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns, text


def is_relevant(
    scope: Column, hint: Column, section: Column, url: Column, title: Column, lead: Column, body: Column,
    needs_mention: Column, from_events: Column, foreign: Column, skipped: Column, mention: Column, mention_section: Column, least: int = 2,
) -> Column:
    """True by the first rule that decides; ``foreign`` and ``skipped`` are arrays, ``mention`` a pattern column."""
    sections = text.url_sections(url)
    abroad = F.arrays_overlap(sections, foreign) | F.coalesce(F.array_contains(foreign, F.lower(section)), F.lit(False))
    head = F.concat_ws(" ", title, lead)
    return (
        F.when(patterns.sports_spam(title), False)
        .when(F.arrays_overlap(sections, skipped), False)
        .when(from_events, True)
        .when((scope == "domestic") & ~needs_mention & (F.coalesce(hint, F.lit("")) != "foreign_policy") & ~abroad, True)
        .when(mention_section.isNotNull() & section.eqNullSafe(mention_section), True)
        .when(F.regexp_like(head, mention), True)
        .otherwise(F.regexp_count(F.coalesce(body, F.lit("")), mention) >= least)
    )


def resolve_scope(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    """``articles`` (country, source_id, source_name, scope, feed_scope) with resolved_scope.

    Sources that no aggregator made keep their own scope. Otherwise: the country's outlet of that name, of the cleaned
    name, the first (by ord) whose name is inside it, the feed's scope, and at last international.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"\.(com|org|net|[a-z]{2})$", ""), r"^(the|le|la|der|die|das|el) ", "")
    o = outlets.select(F.col("country").alias("oc"), "ord", F.lower("name").alias("name"), F.col("scope").alias("os"))
    exact = o.groupBy("oc", "name").agg(F.min_by("os", "ord").alias("exact"))
    a = articles.withColumn("__n", F.lower("source_name")).withColumn("__p", plain(F.col("source_name")))
    a = a.join(F.broadcast(exact), (F.col("country") == F.col("oc")) & (F.col("__n") == F.col("name")), "left").drop("oc", "name")
    cleaned = o.groupBy("oc", plain(F.col("name")).alias("pname")).agg(F.min_by("os", "ord").alias("cleaned"))
    a = a.join(F.broadcast(cleaned), (F.col("country") == F.col("oc")) & (F.col("__p") == F.col("pname")), "left").drop("oc", "pname")
    names = a.select("country", "__n").distinct()
    inside = names.join(F.broadcast(o), (F.col("country") == F.col("oc")) & (F.length("name") >= 4) & F.contains(F.col("__n"), F.col("name")))
    inside = inside.groupBy("country", "__n").agg(F.min_by("os", "ord").alias("inside"))
    a = a.join(inside, ["country", "__n"], "left")
    found = F.coalesce("exact", "cleaned", "inside", "feed_scope", F.lit("international"))
    scope = F.when(~F.startswith(F.col("source_id"), F.lit("gn:")), F.col("scope")).otherwise(found)
    return a.withColumn("resolved_scope", scope).drop("__n", "__p", "exact", "cleaned", "inside")
