"""Catalog operators: ratings, regions, themes, registries, retired desks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_name(c: Column) -> Column:
    """An outlet's name without its domain ending and leading article."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\.(com|org|net|info|[a-z]{2})$", ""), r"^(the|le|la|les|der|die|das|el|il) ", ""))


def rate(sources: DataFrame, ratings: DataFrame) -> DataFrame:
    """``sources`` (id, name, domain, state_affiliated) with bias, alignment, factuality.

    By exact name, by cleaned name, by the first rated name inside it; then official domains, state outlets, unrated.
    Ratings are a catalog of a few thousand rows.
    """
    fields = ["bias", "alignment", "factuality"]
    r = ratings.select("ord", F.lower("name").alias("rn"), clean_name(F.col("name")).alias("rc"), F.struct(*fields).alias("r"))
    s = sources.withColumn("__n", F.lower("name")).withColumn("__c", clean_name(F.col("name")))
    by = lambda key, out: r.groupBy(F.col(key).alias(f"__{out}k")).agg(F.min_by("r", "ord").alias(out))
    s = s.join(F.broadcast(by("rn", "exact")), F.col("__n") == F.col("__exactk"), "left").join(F.broadcast(by("rc", "cleaned")), F.col("__c") == F.col("__cleanedk"), "left")
    inside = s.select("__n").distinct().join(F.broadcast(r), (F.length("rn") >= 4) & F.contains(F.col("__n"), F.col("rn"))).groupBy("__n").agg(F.min_by("r", "ord").alias("inside"))
    s = s.join(inside, "__n", "left")
    fixed = lambda b, a, f: F.struct(F.lit(b).alias("bias"), F.lit(a).alias("alignment"), F.lit(f).alias("factuality"))
    default = F.when(F.col("domain").rlike(r"(^|\.)gov(\.|$)"), fixed("center", "official", "high")).when(F.col("state_affiliated"), fixed("unrated", "state_controlled", "unrated")).otherwise(fixed("unrated", "unrated", "unrated"))
    return s.withColumn("__r", F.coalesce("exact", "cleaned", "inside", default)).select(*sources.columns, *(F.col(f"__r.{f}") for f in fields))


def changed(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of ``new`` whose fields differ from ``old``, nulls compared as values."""
    o = old.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return new.join(o, key).where(~same).select(*new.columns)


def merged_themes(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Themes by id: keywords of both, labels, weights and categories of ``extra`` where it has them, new themes last."""
    e = extra.select(F.col("id").alias("__id"), *(F.col(c).alias(f"__{c}") for c in ("label", "weight", "category", "keywords")))
    j = base.join(e, F.col("id") == F.col("__id"), "full_outer")
    none = F.array().cast("array<string>")
    words = F.array_distinct(F.concat(F.coalesce("keywords", none), F.coalesce("__keywords", none)))
    return j.select(F.coalesce("id", "__id").alias("id"), *(F.coalesce(f"__{c}", c).alias(c) for c in ("label", "weight", "category")), words.alias("keywords"))


def regions(countries: DataFrame, fixed: DataFrame) -> DataFrame:
    """``countries`` (id, region) with their own region, else that of the fixed map, else Other."""
    f = fixed.select(F.col("id").alias("__id"), F.col("region").alias("__r"))
    return countries.join(F.broadcast(f), F.col("id") == F.col("__id"), "left").select("id", F.coalesce("region", "__r", F.lit("Other")).alias("region"))


def of_live_desks(df: DataFrame, desks: DataFrame, key: str = "country") -> DataFrame:
    """Rows whose desk is still in the catalog."""
    return df.join(desks.select(F.col("id").alias(key)), key, "left_semi")


def independent_publishers(sources: DataFrame, floor: int) -> DataFrame:
    """Per country the number of registrable domains and whether it reaches the floor."""
    domain = F.regexp_extract("domain", r"([^.]+\.(?:(?:co|com|org|gov|net|ac)\.)?[^.]+)$", 1)
    return sources.groupBy("country").agg(F.count_distinct(domain).alias("publishers"), (F.count_distinct(domain) >= floor).alias("enough"))


def unknown_keys(packs: DataFrame, valid: list[str]) -> DataFrame:
    """Per pack the keys that no pack may have."""
    return packs.select("id", F.array_sort(F.array_except("keys", F.array(*map(F.lit, valid)))).alias("unknown"))


def source_directory(sources: DataFrame, stored: DataFrame, ratings: DataFrame) -> DataFrame:
    """Sources with the stored rating where there is one, else a fresh lookup."""
    fields = ["bias", "alignment", "factuality"]
    fresh = rate(sources, ratings)
    s = stored.select("id", *(F.nullif(F.col(f), F.lit("unrated")).alias(f"__{f}") for f in fields))
    return fresh.join(s, "id", "left").select(*sources.columns, *(F.coalesce(f"__{f}", f).alias(f) for f in fields))


def country_index(countries: DataFrame, periods: DataFrame, most: int = 12) -> DataFrame:
    """Countries with a published period: id, name, region, language, abroad_label, mentions, periods.

    ``countries``: id, name, region, language, abroad_label, mention (an array); ``periods``: id, period, label, days.
    Mentions are the name and the first ``most`` mention words, in small letters, each once; a missing region is "Other".
    Periods are (id, label, file) from the longest to the shortest, then by id; countries without one are left out.
    """
    file = F.concat_ws("", "id", F.lit("-"), "period", F.lit(".json"))
    item = F.struct((-F.col("days")).alias("o"), F.col("period").alias("id"), "label", file.alias("file"))
    out = periods.select("id", item.alias("p")).distinct().groupBy("id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    words = F.slice(F.coalesce("mention", F.array().cast("array<string>")), 1, most)
    mentions = F.array_distinct(F.transform(F.concat(F.array("name"), words), F.lower))
    shown = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["label"].alias("label"), x["file"].alias("file")))
    return countries.join(out, "id").select("id", "name", F.coalesce("region", F.lit("Other")).alias("region"), "language", "abroad_label", F.array_compact(mentions).alias("mentions"), shown.alias("periods"))
