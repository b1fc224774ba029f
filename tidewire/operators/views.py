"""Reader's views over ranked stories: desks, home page, topics, relations, alerts, briefs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import patterns
from .ranking import global_and_regional, top_per

def dashboard(stories: DataFrame, n: int, per_category: int) -> DataFrame:
    """Story ids of a desk: the top ``n``, then the top of each category, each once, in that order."""
    order = [F.desc(F.coalesce("score", F.lit(0.0))), F.asc("id")]
    a = top_per(stories, ["country"], order, n).select("id", "country", F.lit(0).alias("part"), "rn")
    b = top_per(stories, ["country", "category"], order, per_category).select("id", "country", F.lit(1).alias("part"), "rn")
    return a.unionByName(b).groupBy("country", "id").agg(F.min(F.struct("part", "rn")).alias("first")).select("country", "id", "first.part", "first.rn")


def desk_leads(stories: DataFrame) -> DataFrame:
    """Per country its lead: no sport if possible, no 'other' if possible, then by score."""
    low = patterns.sports_spam(F.col("title")) | (F.forall("themes", lambda t: F.lower(t).contains("sport") | F.lower(t).contains("entertainment")) & (F.size("themes") > 0))
    order = [F.when(low, 1).otherwise(0), F.when(F.col("category") == "other", 1).otherwise(0), F.desc("score"), F.asc("id")]
    return top_per(stories, ["country"], order, 1).select("country", "id")


def topics(stories: DataFrame, first: int = 4) -> DataFrame:
    """The first stories of each topic; topics by their best score, 'other' last."""
    best = F.max("score").over(Window.partitionBy("country", "category"))
    rows = top_per(stories.withColumn("best", best), ["country", "category"], [F.desc("score"), F.asc("id")], first)
    w = Window.partitionBy("country").orderBy((F.col("category") == "other").cast("int"), F.desc("best"), "category", "rn")
    return rows.withColumn("place", F.row_number().over(w)).select("country", "category", "id", "place")


def unique_sections(sections: list[tuple[str, DataFrame, int]], order: list[Column]) -> DataFrame:
    """Stories in sections, each in the first section that has it, so many per section."""
    rows = reduce(DataFrame.unionByName, (d.withColumn("section", F.lit(n)).withColumn("__s", F.lit(k)).withColumn("__m", F.lit(m)) for k, (n, d, m) in enumerate(sections)))
    one = Window.partitionBy("id").orderBy("__s")
    rows = rows.withColumn("__o", F.row_number().over(one)).where("__o = 1")
    w = Window.partitionBy("__s").orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.col("__m")).drop("__s", "__m", "__o")


def home(stories: DataFrame) -> dict[str, DataFrame]:
    """The home page's lists: most covered, growing, elections, disasters, violence, each with its quotas."""
    order = lambda c: [F.desc(c), F.desc("score"), F.asc("id")]
    return {
        "most": global_and_regional(stories, order("breadth"), 8, 3, 2),
        "growing": global_and_regional(stories.where("state in ('new', 'surging')"), order("velocity"), 6, 3, 2),
        "elections": global_and_regional(stories.where(patterns.is_election(F.col("themes"))), order("breadth"), 6, 3, 1),
        "disasters": global_and_regional(stories.where(patterns.disaster_label(F.col("title"), F.col("themes")).isNotNull()), order("breadth"), 12, 5, 2),
        "violence": global_and_regional(stories.where(patterns.violence_label(F.col("title"), F.col("themes")).isNotNull()), order("breadth"), 12, 5, 2),
    }


def movement(state: Column, shift: Column, wanted: str) -> Column:
    return {"surge_new": state.isin("new", "surging"), "pickup": shift.isNotNull()}.get(wanted, F.lit(True))


def perspective(state_share: Column, scopes: Column, independent: Column) -> Column:
    return (
        F.when(state_share >= 0.7, "mostly state outlets").when(state_share >= 0.35, "mixed state and independent")
        .when(scopes >= 2, "several perspectives").when(independent >= 2, "independent outlets").otherwise("single source")
    )


def relations_panel(stories: DataFrame) -> DataFrame:
    """One row over matched stories: sums of both windows, counts by state, the leading category and its share."""
    top = stories.groupBy("category").agg(F.count("*").alias("n")).agg(F.max_by("category", F.struct("n", "category")).alias("top"), (100.0 * F.max("n") / F.sum("n")).alias("top_pct"))
    states = (F.count_if(F.col("state") == s).alias(s) for s in ("new", "surging", "cooling", "steady", "trace"))
    return stories.agg(F.sum("curr").alias("curr"), F.sum("prev").alias("prev"), *states).crossJoin(top)  # one row each


def hot_alerts(alerts: DataFrame, now: Column, most: int = 15) -> DataFrame:
    """The newest alerts of a day, or of a week if the day has none."""
    day, week = (F.col("at") >= now - F.make_dt_interval(F.lit(n)) for n in (1, 7))
    some = alerts.agg(F.count_if(day).alias("today"))  # one row
    rows = alerts.crossJoin(some).where(F.when(F.col("today") > 0, day).otherwise(week)).drop("today")
    return rows.orderBy(F.desc("at"), "id").limit(most)


def band_document(stories: DataFrame, members: DataFrame, quotes: DataFrame) -> DataFrame:
    """Story documents: the ranked row, its listed articles and quotations as nested arrays.

    Members are cut to the listed few per story before they are gathered.
    """
    listed = top_per(members, ["story_id"], [F.desc("similarity"), F.asc("id")], 24)
    a = listed.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("rn", "id", "title", "url", "source_id", "scope"))).alias("sources"))
    q = quotes.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "sentence"))).alias("excerpts"))
    return stories.join(a, "story_id", "left").join(q, "story_id", "left")


#: How many articles of a story's three bands are listed.
LISTED = {"core": 10, "close": 8, "broad": 6}


def story_records(stories: DataFrame, members: DataFrame, quotes: DataFrame, edges: DataFrame, deltas: DataFrame, now: Column) -> DataFrame:
    """Stories whole: counts of their core, who covers them and how that side stands, days, listed articles, quotations,
    related stories and how the window compares with the one before.

    ``stories``: story_id and what they have of their own; ``members``: story_id, id, at, similarity, title, url, source_id,
    scope, kind, alignment, bias, factuality, syndicated_of; ``quotes``, ``edges``, ``deltas`` as ``excerpts.choose``,
    ``related`` and ``delta.story_deltas`` have them. Core rows have a similarity of 0.93 or more; a story without any has
    all rows as its core. What a story gathers is bounded: listed rows, labels, days. No window holds a whole story but
    that of a band, which is cut to its listed rows before the shuffle.
    """
    sim = F.coalesce("similarity", F.lit(1.0))
    rows = members.withColumn("similarity", sim)
    some = rows.groupBy("story_id").agg(F.max(F.col("similarity") >= 0.93).alias("__some"))
    rows = rows.join(some, "story_id").withColumn("core", (F.col("similarity") >= 0.93) | ~F.col("__some")).drop("__some")
    core = F.col("core")
    with_state = F.coalesce(F.col("alignment").isin("state_controlled", "pro_government") | (F.col("kind") == "official"), F.lit(False))
    facts = rows.groupBy("story_id").agg(
        F.count("*").alias("articles"),
        F.greatest(F.lit(1), F.count_distinct(F.when(core & F.col("syndicated_of").isNull(), F.col("source_id")))).alias("independent"),
        *(F.count_if(core & (F.col("scope") == s)).alias(s) for s in ("domestic", "abroad_local", "international")),
        F.when(F.max(core & (F.col("kind") == "official")), "OFFICIAL").otherwise("REPORTED").alias("evidence"),
        F.round(F.count_if(core & with_state) / F.count_if(core), 2).alias("state_share"),
        F.count_if(core & (F.col("at") >= now - F.make_dt_interval(F.lit(1)))).alias("last_24h"),
        F.min_by(F.when(core & F.col("at").isNotNull(), F.struct("source_id", "at")), F.when(core & F.col("at").isNotNull(), F.struct("at", "id"))).alias("first"),
    )
    count = lambda c, name: rows.where(core & F.col(c).isNotNull() & (F.col(c) != "unrated")).groupBy("story_id", F.col(c).alias("label")).agg(F.count("*").alias("n")).groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("label", "n"))).alias(name))
    days = rows.where(core & F.col("at").isNotNull()).groupBy("story_id", F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    days = days.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("day", "n"))).alias("per_day"))
    band = F.when(F.col("similarity") >= 0.93, "core").when(F.col("similarity") >= 0.85, "close").otherwise("broad")
    copy = F.col("syndicated_of").isNotNull()
    order = [copy.cast("int"), F.desc("similarity"), F.asc("at"), F.asc("id")]
    listed = top_per(rows.withColumn("band", band), ["story_id", "band"], order, max(LISTED.values()))
    listed = listed.where(F.col("rn") <= F.coalesce(*(F.when(F.col("band") == b, n) for b, n in LISTED.items())))
    place = F.when(F.col("band") == "core", 0).when(F.col("band") == "close", 1).otherwise(2)
    rated = lambda c: F.coalesce(c, F.lit("unrated")).alias(c)
    one = F.struct(place.alias("part"), "rn", "id", "title", "url", "source_id", "scope", "at", copy.alias("copy"), F.round(F.col("similarity") * 100).cast("int").alias("sim"), *map(rated, ("bias", "alignment", "factuality")))
    listed = listed.groupBy("story_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))
    said = quotes.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "sentence"))).alias("excerpts"))
    near = related(edges, facts.select("story_id", "articles"))
    near = near.groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("rn", "other", "articles"))).alias("related"))
    moved = deltas.select("story_id", F.struct(*(c for c in deltas.columns if c != "story_id")).alias("delta"))
    out = stories.drop(*(c for c in facts.columns if c != "story_id")).join(facts, "story_id")
    for part in (count("alignment", "alignment"), count("bias", "bias"), days, listed, said, near, moved):
        out = out.join(part, "story_id", "left")
    return out


def related(edges: DataFrame, stories: DataFrame, most: int = 2) -> DataFrame:
    """Per story its closest related stories with their core size; edges are taken both ways."""
    both = edges.select(F.col("a").alias("story_id"), F.col("b").alias("other"), "sim").union(edges.select("b", "a", "sim"))
    s = stories.select(F.col("story_id").alias("other"), "articles")
    return top_per(both.join(s, "other"), ["story_id"], [F.desc("sim"), F.asc("other")], most).select("story_id", "other", "articles", "rn")


def markdown(stories: DataFrame) -> DataFrame:
    """Brief lines per topic."""
    line = F.concat(F.lit("- "), "title", F.lit(" ("), F.col("independent").cast("string"), F.lit(" outlets; "), "perspective", F.lit(")"))
    return stories.groupBy("category").agg(F.concat(F.lit("## "), F.first("category"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n")).alias("section"))


def sample(stories: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """``k`` stories in the order of a seeded hash; a report that samples by its purpose."""
    return stories.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)
