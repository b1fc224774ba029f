"""The event monitor: stories tagged by what their titles say, the tracks they are in, and the pool of a period.

A story has id, title, en_title, titles (its outlets' titles, an array), themes, category, last_seen, and what it was
tagged with before: disaster_type, violence_type, traditions (an array). All of it may be null. Words are looked for in
folded titles; folding is the one step outside the JVM, one call per story.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as fixed
from ..functions import patterns, text

VIOLENCE = dict(fixed.FOLDED_VIOLENCE)
#: Tracks of violence, with the label that puts a story in them, and tracks of faiths.
TRACKS = {"armed_clash": "Armed Clash & Strike", "insurgency": "Insurgency & Terror", "unrest": "Civil Unrest & Crackdown"}
FAITH_TRACKS = {"rel_jewish": "Judaism", "rel_christian": "Christianity", "rel_islam": "Islam", "rel_other": "Other Faiths & Sites"}
#: Themes that keep a story in the pool of violence.
VIOLENT = ["Civil unrest and armed conflict", "Sectarian and confessional violence"]


def _has(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))


def _listed(c: Column, rules: list[tuple[str, str]]) -> Column:
    """The labels of all rules whose pattern is found, in order."""
    return F.array_compact(F.array(*(F.when(patterns.matches(c, p), label) for label, p in rules)))


def _folded(outlets: int) -> Column:
    """The folded headline (with its translation), then those of the first outlets, each on its own; empty ones stay empty."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\n", " ")
    own = F.when(plain(F.col("title")) == "", "").otherwise(F.concat_ws(" ", plain(F.col("title")), plain(F.col("en_title"))))
    others = F.transform(F.slice(F.coalesce("titles", F.array().cast("array<string>")), 1, outlets), plain)
    return F.split(text.fold(F.concat_ws("\n", F.concat(F.array(own), others))), "\n")


def _no_event() -> Column:
    """Stories of sport, culture and entertainment, which the monitor leaves alone."""
    low = F.lower(F.concat_ws(" ", F.coalesce("themes", F.array().cast("array<string>"))))
    return _has(low, ["sport", "culture", "entertainment"]) | F.coalesce(F.col("category") == "sport_culture", F.lit(False))


def tagged(stories: DataFrame) -> DataFrame:
    """``stories`` with disaster_type, violence_type and traditions filled in where titles tell and nothing was said before.

    Disasters and violence are looked for in the headline and the first three outlets' titles together; words of arts or
    sport rule violence out, and words of harm alone count where category or themes speak of security. A faith counts
    only where a word of it and a word of harm stand in one and the same title without a word of arts or sport; the first
    such title tells all of them. Traditions are null where no title does.
    """
    low = F.lower(F.concat_ws(" ", F.coalesce("themes", F.array().cast("array<string>"))))
    rows = stories.withColumn("__t", _folded(3)).withColumn("__lead", F.concat_ws(" ", "__t"))
    lead, leave = F.col("__lead"), _no_event()
    secure = F.coalesce(F.col("category") == "defence_security", F.lit(False)) | _has(low, ["security", "conflict", "violence"])
    harm = F.when(patterns.matches(lead, fixed.HARM) & secure, TRACKS["armed_clash"])
    violent = F.when(~patterns.matches(lead, fixed.ARTS_OR_SPORT), F.coalesce(patterns.first_label(lead, fixed.FOLDED_VIOLENCE), harm))
    of_title = lambda t: F.when(patterns.matches(t, fixed.HARM) & ~patterns.matches(t, fixed.ARTS_OR_SPORT), _listed(t, fixed.FAITHS))
    faiths = F.get(F.filter(F.transform("__t", of_title), lambda hits: F.size(hits) > 0), 0)
    fill = lambda name, found: F.when(leave | F.col(name).isNotNull(), F.col(name)).otherwise(found).alias(name)
    new = {"disaster_type": patterns.first_label(lead, fixed.FOLDED_DISASTERS), "violence_type": violent, "traditions": faiths}
    return rows.select(*(fill(c, new[c]) if c in new else c for c in stories.columns))


def tracks(stories: DataFrame) -> DataFrame:
    """Tagged stories with tracks, an array: those of their faiths, then those of violence by tag or by a title's words
    (headline and four outlets); words of arts or sport rule the latter out."""
    of = F.coalesce("traditions", F.array().cast("array<string>"))
    rows = stories.withColumn("__lead", F.concat_ws(" ", _folded(4)))
    lead = F.col("__lead")
    calm = patterns.matches(lead, fixed.ARTS_OR_SPORT)
    found = [F.when(F.size(of) > 0, "rel_all"), *(F.when(F.array_contains(of, label), name) for name, label in FAITH_TRACKS.items())]
    for name, label in TRACKS.items():
        said = F.coalesce(F.col("violence_type") == label, F.lit(False)) | patterns.matches(lead, VIOLENCE[label])
        found.append(F.when(~calm & said, name))
    return rows.withColumn("tracks", F.array_compact(F.array(*found))).drop("__lead")


def alert_tracks(alerts: DataFrame) -> DataFrame:
    """Alerts (country_name, region, kind, title, summary) with tracks: of violence by their words, of faiths only beside a
    word of harm, none beside a word of arts or sport."""
    parts = [F.coalesce(c, F.lit("")) for c in ("country_name", "region", "kind", "title", "summary")]
    rows = alerts.withColumn("__t", text.fold(F.concat_ws(" ", *parts)))
    t = F.col("__t")
    harm = patterns.matches(t, fixed.HARM)
    faiths = [F.when(harm & patterns.matches(t, pattern), name) for name, (_, pattern) in zip(FAITH_TRACKS, fixed.FAITHS)]
    found = [F.when(F.coalesce(*faiths).isNotNull(), "rel_all"), *faiths]
    found += [F.when(patterns.matches(t, VIOLENCE[label]), name) for name, label in TRACKS.items()]
    none = F.array().cast("array<string>")
    return rows.withColumn("tracks", F.when(patterns.matches(t, fixed.ARTS_OR_SPORT), none).otherwise(F.array_compact(F.array(*found)))).drop("__t")


def event_pool(lists: list[DataFrame], mode: str, since: Column | None = None) -> DataFrame:
    """Tagged stories of ``lists`` that belong in the monitor of "disasters" or "violence", each id once.

    A story that was last seen before ``since`` or is of sport, culture or entertainment isn't kept; where several lists
    keep an id, the first list's row stays (within one list the one seen last, then by title). Rows come unordered; the
    monitor shows them by last_seen. An id is a story of its own where it is null.
    """
    rows = reduce(DataFrame.unionByName, (df.withColumn("__list", F.lit(k)) for k, df in enumerate(lists)))
    if since is not None:
        rows = rows.where(F.col("last_seen") >= since)
    rows = tagged(rows.where(~_no_event()))
    if mode == "disasters":
        rows = rows.where(F.col("disaster_type").isNotNull())
    else:
        themes = F.coalesce(F.arrays_overlap("themes", F.array(*map(F.lit, VIOLENT))), F.lit(False))
        rows = rows.where(F.col("violence_type").isNotNull() | themes | (F.size(F.coalesce("traditions", F.array().cast("array<string>"))) > 0))
    known = rows.where("id is not null")
    first = Window.partitionBy("id").orderBy("__list", F.desc("last_seen"), "title", F.to_json(F.struct(*known.columns)))
    once = known.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn")
    return once.unionByName(rows.where("id is null")).drop("__list")
