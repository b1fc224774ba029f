"""Crisis events, alerts and social posts: assignment, greedy deduplication and caps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from . import catalog
from .graph import small


def assign_desks(events: DataFrame, desks: DataFrame) -> DataFrame:
    """(event_id, desk, priority): one desk per event; a primary name in the place, a regional one, the country in the title."""
    hit = lambda c, p: F.coalesce(F.regexp_like(F.col(c), F.col(p)), F.lit(False))
    met = events.join(small(desks), F.regexp_like("blob", F.col("any_re")))  # desks are a catalog of about a hundred rows
    prio = F.when(hit("place", "primary_re"), 3).when(hit("place", "regional_re"), 2).when(hit("title", "country_re"), 1).otherwise(0)
    w = Window.partitionBy("event_id").orderBy(F.desc("priority"), "desk")
    return met.withColumn("priority", prio).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("event_id", "desk", "priority")


def dedupe_fuzzy(items: DataFrame, by: str, most: int = 5) -> DataFrame:
    """Per group the newest items that tell something new: walked newest first, dropped if (kind, title) was kept or if
    two or more telling words, and half of the smaller set, are those of a kept one; ``most`` are kept.

    The walk depends on what was kept, so it is a grouped map; an item's tokens come from built-in functions, and a
    group stops at ``most``.
    """
    rows = items.withColumn("tokens", text.significant_tokens("title")).withColumn("key", F.lower("title"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id"], ascending=[False, True], na_position="last")
        seen, kept, out = set(), [], []
        for r in pdf.itertuples():
            tokens = set(r.tokens)
            if (r.kind, r.key) in seen or len(tokens) >= 2 and any(len(tokens & k) >= 2 and 2 * len(tokens & k) >= min(len(tokens), len(k)) for k in kept):
                continue
            seen.add((r.kind, r.key))
            if tokens:
                kept.append(tokens)
            out.append(r.Index)
            if len(out) == most:
                break
        return pdf.loc[out, [by, "id"]].assign(place=range(1, len(out) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    return rows.select(by, "id", "kind", "key", "at", "tokens").groupBy(by).applyInPandas(walk, f"{by} {kinds[by]}, id {kinds['id']}, place int")


def cap_posts(posts: DataFrame, limit: int = 8, per_author: int = 5) -> DataFrame:
    """Per desk the newest posts, one per normalised text, ``per_author`` of an author and ``limit`` in all."""
    rows = posts.withColumn("key", text.norm_key("text"))
    one = Window.partitionBy("desk", "key").orderBy(F.desc("at"), "id")
    rows = rows.withColumn("__k", F.row_number().over(one)).where("key = '' or __k = 1")
    mine = Window.partitionBy("desk", "author").orderBy(F.desc("at"), "id")
    rows = rows.withColumn("__a", F.row_number().over(mine)).where(F.col("__a") <= per_author)
    all_ = Window.partitionBy("desk").orderBy(F.desc("at"), "id")
    return rows.withColumn("place", F.row_number().over(all_)).where(F.col("place") <= limit).drop("key", "__k", "__a")


def quake_level(title: Column) -> Column:
    """Level by magnitude in the title; null below 5.0."""
    m = F.regexp_extract(title, r"M\s*(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(m >= 6, "Warning").when(m >= 5.5, "Alert").when(m >= 5, "Caution")


def distinct_alerts(alerts: DataFrame) -> DataFrame:
    """One row per (kind, lower title): newest date and the countries that show it."""
    key = F.lower("title")
    return alerts.groupBy("kind", key.alias("key")).agg(F.max("at").alias("at"), F.sort_array(F.collect_set("country")).alias("countries"), F.count("*").alias("n"))


def pack_batches(desks: DataFrame, max_desks: int = 6, max_items: int = 18) -> DataFrame:
    """(desk, batch): desks in order, a new batch once one more would exceed a limit; the catalog is one small group."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        batch, n, items, out = 0, 0, 0, []
        for r in pdf.sort_values("desk").itertuples():
            if n and (n + 1 > max_desks or items + r.n_items > max_items):
                batch, n, items = batch + 1, 0, 0
            n, items = n + 1, items + r.n_items
            out.append((r.desk, batch))
        return pd.DataFrame(out, columns=["desk", "batch"])

    return desks.groupBy().applyInPandas(pack, f"desk {desks.schema['desk'].dataType.simpleString()}, batch int")


#: Length of a text from which on an article counts as read.
READ = 200


def merge_conflicts(events: DataFrame, desks: DataFrame, outlets: DataFrame, sources: DataFrame, articles: DataFrame, ratings: DataFrame | None = None, prefix: str = "gdelt:") -> tuple[DataFrame, DataFrame]:
    """(sources, articles) once conflict events are in them; another run with the same events changes nothing.

    ``events``: event_id, title, place, blob, url, at, site, lead, text. ``desks`` as ``assign_desks`` has them, with geo;
    ``outlets``: country, place, id, homepage, language, scope, the outlets that desks know. ``sources``: id, name, homepage,
    language, scope, bias, alignment, factuality. ``articles``: url, source_id, country, title, lead, text, language, at, status,
    relevant. Events go to one desk each; those of no desk or without an address's domain go. Of a known outlet that is among ``sources`` the article is
    its own; others belong to a source that goes by the domain, which is new or merged column by column: the scope only
    moves towards home, ratings are those that ``ratings`` (as ``catalog.rate`` takes them) give its outlet. An address enters once, by its first event (by event_id);
    where it is known, its missing text is filled in and its status follows.
    """
    at_desk = assign_desks(events, desks.drop("geo")).join(desks.select("desk", "geo"), "desk")
    rows = events.join(at_desk.select("event_id", F.col("desk").alias("country"), "geo"), "event_id").withColumn("url", text.clean_url("url"))
    rows = rows.withColumn("domain", text.domain("url")).where("domain <> ''")
    known = outlets.select("country", text.domain("homepage").alias("domain"), "place", F.struct("place", "id", "language", "scope").alias("o"))
    known = known.groupBy("country", "domain").agg(F.min("o").alias("o"))
    rows = rows.join(known, ["country", "domain"], "left")
    there = sources.select(F.col("id").alias("__id"))
    rows = rows.join(there, F.col("o.id") == F.col("__id"), "left").withColumn("own", F.col("__id").isNotNull()).drop("__id")
    rows = rows.withColumn("source_id", F.when(F.col("own"), F.col("o.id")).otherwise(F.concat(F.lit(prefix), "domain"))).withColumn("language", F.coalesce("o.language", F.lit("en")))
    geo = F.lower(F.coalesce("geo", F.lit("")))
    at_home = (F.length(geo) == 2) & (F.endswith("domain", F.concat(F.lit("."), geo)) | F.contains(F.col("domain"), F.concat(F.lit("."), geo, F.lit("."))))
    rows = rows.withColumn("scope", F.coalesce("o.scope", F.when(at_home, "domestic").otherwise("international")))
    home = lambda c: F.when(F.col(c) == "domestic", 0).when(F.col(c) != "international", 1).otherwise(2)
    found = rows.where(~F.col("own")).groupBy("source_id").agg(
        F.min_by(F.struct(F.coalesce("site", "domain").alias("name"), F.concat(F.lit("https://"), "domain").alias("homepage"), "language"), "event_id").alias("n"),
        F.min_by("scope", F.struct(home("scope"), "event_id")).alias("__scope"),
    )
    rated = ["bias", "alignment", "factuality"]
    if ratings is None:
        found = found.withColumns({f"__{c}": F.lit(None).cast("string") for c in rated})
    else:
        outlets_found = found.select(F.col("source_id").alias("id"), F.col("n.name").alias("name"), text.domain("n.homepage").alias("domain"), F.lit(False).alias("state_affiliated"))
        given = catalog.rate(outlets_found, ratings).select(F.col("id").alias("source_id"), *(F.col(c).alias(f"__{c}") for c in rated))
        found = found.join(given, "source_id", "left")
    merged = sources.join(found, F.col("id") == F.col("source_id"), "full_outer")
    nearer = F.col("scope").isNull() | (home("__scope") < home("scope"))
    merged = merged.select(
        F.coalesce("id", "source_id").alias("id"), *(F.coalesce(c, f"n.{c}").alias(c) for c in ("name", "homepage", "language")),
        F.when(F.col("__scope").isNotNull() & nearer, F.col("__scope")).otherwise(F.col("scope")).alias("scope"),
        *(F.when(F.col("id").isNull(), F.coalesce(f"__{c}", F.lit("unrated"))).otherwise(F.coalesce(f"__{c}", c)).alias(c) for c in rated),
    )
    has = F.col("text").isNotNull()
    new = rows.groupBy(F.col("url").alias("__url")).agg(
        F.min_by(F.struct("source_id", "country", "title", "lead", "text", "language", "at"), "event_id").alias("n"),
        F.min_by(F.when(has, F.col("text")), F.when(has, F.col("event_id"))).alias("__text"),
    )
    out = articles.join(new, F.col("url") == F.col("__url"), "full_outer")
    is_old, met = F.col("url").isNotNull(), F.col("__url").isNotNull()
    entered = F.when(F.length("n.text") > READ, "ok").when(F.col("n.text").isNull() & F.col("__text").isNotNull(), "ok").otherwise("pending")
    status = F.when(is_old & met & F.col("text").isNull() & F.col("__text").isNotNull(), "ok").when(is_old, F.col("status")).otherwise(entered)
    plain = ["source_id", "country", "title", "language", "at"]
    out = out.select(
        F.coalesce("url", "__url").alias("url"), *(F.when(is_old, F.col(c)).otherwise(F.col(f"n.{c}")).alias(c) for c in plain),
        F.when(is_old, F.col("lead")).otherwise(F.coalesce("n.lead", F.lit(""))).alias("lead"), F.coalesce("text", "__text").alias("text"),
        status.alias("status"), (met | F.coalesce("relevant", F.lit(False))).alias("relevant"),
    )
    return merged, out.select(*articles.columns)
