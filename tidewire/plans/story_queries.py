"""Named queries of whole stories: windows compared day by day, matches of the window before, records, merged events."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import vectors
from ..operators import delta, events, excerpts, stories, views
from .fixtures import ARTICLE, FACTS_SQL, NOW, articles, pick, read, story_facts
from .queries import VECTOR, drained, query, streamed

#: What is said of both windows, given counts by (story_id, more).
COMPARED = """curr - prev AS net, round(curr / greatest(1, prev), 2) AS ratio, round(coalesce(sc / nullif(cc, 0), 0), 2) AS s1, round(coalesce(sp / nullif(cp, 0), 0), 2) AS s0"""
COUNTS = """count(*) FILTER (p = 'curr') AS curr, count(*) FILTER (p = 'prev') AS prev,
    count(*) FILTER (p = 'prev' AND scope = 'domestic') AS pd, count(*) FILTER (p = 'curr' AND scope = 'international') AS ci, count(*) FILTER (p = 'curr' AND scope = 'abroad_local') AS ca,
    count(*) FILTER (p = 'curr' AND similarity >= 0.93) AS cc, count(*) FILTER (p = 'prev' AND similarity >= 0.93) AS cp,
    count(*) FILTER (p = 'curr' AND similarity >= 0.93 AND state_outlet) AS sc, count(*) FILTER (p = 'prev' AND similarity >= 0.93 AND state_outlet) AS sp"""
SAID = """story_id, curr, prev, net, ratio,
  CASE WHEN prev = 0 AND curr >= 2 THEN 'new' WHEN net >= 3 AND ratio >= 1.75 THEN 'surging' WHEN net <= -3 AND ratio <= 0.4 THEN 'cooling' WHEN curr >= 2 THEN 'steady' ELSE 'trace' END AS state,
  round(net / sqrt(greatest(1, prev)), 2) AS velocity_z,
  CASE WHEN prev > 0 AND pd = prev AND ci > 0 THEN 'international_pickup' WHEN prev > 0 AND pd = prev AND ca > 0 THEN 'diaspora_pickup' END AS scope_shift,
  s1 AS state_share_curr, s0 AS state_share_prev, cc >= 4 AND cp >= 4 AND round(s1 - s0, 2) >= 0.3 AS state_surge, cc >= 4 AND cp >= 4 AND round(s1 - s0, 2) <= -0.3 AS state_recede"""

REPLAY = f"""WITH {ARTICLE}, x AS (SELECT *, unnest(range(1, 15)) AS back FROM article),
p AS (SELECT *, date_trunc('day', tm)::TIMESTAMP + to_days(CAST(back AS INTEGER)) AS as_of, CASE WHEN back <= 7 THEN 'curr' ELSE 'prev' END AS p FROM x),
g AS (SELECT as_of, story_id, {COUNTS} FROM p GROUP BY 1, 2), h AS (SELECT *, {COMPARED} FROM g)
SELECT as_of, {SAID} FROM h"""


@query(REPLAY)
def story_deltas_replay(spark, sf_dir):
    """The comparison of every day with a window of seven days, from the articles as a table."""
    return streaming.story_deltas(articles(spark, sf_dir), 7, "1 day")


@query(REPLAY)
def story_deltas_stream(spark, sf_dir):
    """The same, from the documents as a stream in complete mode."""
    stream = streamed(spark, sf_dir, "documents")
    return drained(streaming.story_deltas(articles(spark, sf_dir, stream), 7, "1 day"), "complete")


#: Vectors of 4 January on are the present window of a week; the week before it is matched with their stories.
AT = "2024-01-11 00:00:00"
PRIOR = f"""{VECTOR}, m AS (SELECT id, label AS story_id, label % 3 AS country, v, tm, tm >= TIMESTAMP '{AT}' - INTERVAL 7 DAY AS now FROM v),
x AS (SELECT story_id, country, unnest(v) AS v, generate_subscripts(v, 1) AS p FROM m WHERE now),
c AS (SELECT story_id, country, list(a ORDER BY p) AS c FROM (SELECT story_id, country, p, avg(v) AS a FROM x GROUP BY 1, 2, 3) GROUP BY 1, 2),
u AS (SELECT *, list_transform(c, lambda y: y / sqrt(list_dot_product(c, c))) AS centre FROM c),
s AS (SELECT m.id, m.tm, u.story_id, list_dot_product(m.v, u.centre) AS sim FROM m JOIN u USING (country) WHERE NOT m.now),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, story_id) = 1)"""
NEAR, CORE = 0.25, 0.3


def _prior(spark, sf_dir):
    """Present members and what is nearest to their stories in the window before."""
    v = read(spark, sf_dir, "embeddings")
    v = v.select(F.col("vec_id").alias("id"), F.col("label").alias("story_id"), (F.col("label") % 3).alias("country"), F.expr("timestamp '2024-01-01' + make_dt_interval(0, cast(vec_id % 240 as int))").alias("at"), F.col("embedding").cast("array<double>").alias("vector"))
    v = v.withColumns({"scope": F.when(F.col("id") % 3 == 0, "international").otherwise("domestic"), "state_outlet": F.col("id") % 4 == 1})
    now = F.col("at") >= F.expr(f"timestamp '{AT}' - interval 7 days")
    mean = vectors.mean_vectors(v.where(now), ["story_id", "country"], "vector", "mean")
    near = stories.nearest_centres(v.where(~now), mean.withColumn("centre", vectors.unit("mean")))
    return v, now, near


@query(f"""WITH {PRIOR},
r AS (SELECT id, story_id, 'curr' AS p, 1.0 AS similarity FROM m WHERE now UNION ALL SELECT id, story_id, 'prev', CASE WHEN sim >= {CORE} THEN 0.93 ELSE 0.9 END FROM best WHERE sim >= {NEAR}),
q AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'international' ELSE 'domestic' END AS scope, id % 4 = 1 AS state_outlet FROM r),
g AS (SELECT story_id, {COUNTS} FROM q GROUP BY 1), h AS (SELECT *, {COMPARED} FROM g) SELECT {SAID} FROM h""")
def prior_story_deltas(spark, sf_dir):
    v, now, near = _prior(spark, sf_dir)
    matches = near.join(v.select("id", "at", "scope", "state_outlet"), "id")
    members = delta.with_prior_matches(v.where(now).withColumn("similarity", F.lit(1.0)), matches, AT, 7, NEAR, CORE)
    return delta.story_deltas(members, AT, 7)


@query(f"""WITH {PRIOR}, k AS (SELECT m.id, m.country, CASE WHEN m.id % 5 = 0 THEN 'economics' END AS own,
    (SELECT ['society', 'other', 'defence_security'][CAST(b.story_id % 3 AS INTEGER) + 1] FROM best b WHERE b.id = m.id AND b.sim >= {NEAR}) AS near,
    ['foreign_policy', 'sport', 'society'][CAST(m.id % 3 AS INTEGER) + 1] AS hint FROM m WHERE NOT m.now)
SELECT country, coalesce(own, near, CASE WHEN hint <> 'sport' THEN hint END, 'other') AS category, count(*) AS n FROM k GROUP BY 1, 2""")
def prior_category_counts(spark, sf_dir):
    v, now, near = _prior(spark, sf_dir)
    matches = near.withColumn("category", pick(["society", "other", "defence_security"], F.col("story_id")))
    prior = v.where(~now).withColumns({"story_category": F.when(F.col("id") % 5 == 0, "economics"), "hint": pick(["foreign_policy", "sport", "society"], F.col("id"))})
    return delta.prior_categories(prior, matches, NEAR)


ALIGNED, BIASED = ["independent", "state_controlled", "unrated", "pro_government", "mixed"], ["left", "unrated", "right"]


@query(f"""WITH {ARTICLE}, {FACTS_SQL}, b AS (SELECT *, {ALIGNED!r}[CAST(id % 5 AS INTEGER) + 1] AS alignment, {BIASED!r}[CAST(id % 3 AS INTEGER) + 1] AS bias FROM article),
c AS (SELECT *, similarity >= 0.93 OR NOT bool_or(similarity >= 0.93) OVER (PARTITION BY story_id) AS core FROM b),
f AS (SELECT story_id, count(*) AS articles, greatest(1, count(DISTINCT source_id) FILTER (core AND syndicated_of IS NULL)) AS independent,
    CASE WHEN bool_or(core AND kind = 'official') THEN 'OFFICIAL' ELSE 'REPORTED' END AS evidence,
    round(count(*) FILTER (core AND (alignment IN ('state_controlled', 'pro_government') OR kind = 'official')) / count(*) FILTER (core), 2) AS state_share,
    count(*) FILTER (core AND tm >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS last_24h, arg_min(source_id, (tm, id)) FILTER (core) AS first_source FROM c GROUP BY 1),
a AS (SELECT story_id, string_agg(alignment || ':' || n, ',' ORDER BY alignment) AS alignment FROM (SELECT story_id, alignment, count(*) AS n FROM c WHERE core AND alignment <> 'unrated' GROUP BY 1, 2) GROUP BY 1),
i AS (SELECT story_id, string_agg(bias || ':' || n, ',' ORDER BY bias) AS bias FROM (SELECT story_id, bias, count(*) AS n FROM c WHERE core AND bias <> 'unrated' GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT story_id, string_agg(day || ':' || n, ',' ORDER BY day) AS per_day FROM (SELECT story_id, CAST(CAST(tm AS DATE) AS VARCHAR) AS day, count(*) AS n FROM c WHERE core GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT story_id, id, part, row_number() OVER (PARTITION BY story_id, part ORDER BY (syndicated_of IS NOT NULL)::INT, similarity DESC, tm, id) AS rn FROM (
  SELECT *, CASE WHEN similarity >= 0.93 THEN 0 WHEN similarity >= 0.85 THEN 1 ELSE 2 END AS part FROM c)),
s AS (SELECT story_id, string_agg(id, ',' ORDER BY part, rn) AS listed FROM l WHERE rn <= [10, 8, 6][part + 1] GROUP BY 1),
e AS (SELECT DISTINCT a.story_id, (a.story_id * 5 + 2) % 37 AS other FROM article a), y AS (SELECT story_id, other FROM e UNION SELECT other, story_id FROM e WHERE other IN (SELECT story_id FROM article)),
z AS (SELECT y.story_id, string_agg(y.other || ':' || n.articles, ',' ORDER BY y.sim DESC, y.other) AS related FROM (
  SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY sim DESC, other) AS rn FROM (SELECT y.story_id, y.other, greatest(y.story_id, y.other) / 100.0 AS sim FROM y WHERE y.other IN (SELECT story_id FROM article) AND y.story_id <> y.other)) y
  JOIN f n ON n.story_id = y.other WHERE y.rn <= 2 GROUP BY 1),
p AS (SELECT *, CASE WHEN tm >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'curr' WHEN tm >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY THEN 'prev' END AS p FROM article),
g AS (SELECT story_id, {COUNTS} FROM p WHERE p IS NOT NULL GROUP BY 1), h AS (SELECT *, {COMPARED} FROM g), v AS (SELECT {SAID} FROM h)
SELECT f.*, t.policy, a.alignment, i.bias, d.per_day, s.listed, z.related, v.curr, v.prev, v.state, v.scope_shift
FROM f JOIN story t USING (story_id) LEFT JOIN a USING (story_id) LEFT JOIN i USING (story_id) LEFT JOIN d USING (story_id) LEFT JOIN s USING (story_id) LEFT JOIN z USING (story_id) LEFT JOIN v USING (story_id)""")
def story_records(spark, sf_dir):
    i = F.col("id")
    a = articles(spark, sf_dir).withColumns({"alignment": pick(ALIGNED, i), "bias": pick(BIASED, i)})
    quotes = excerpts.choose(excerpts.sentences(a.select("id", "text")).join(a.select("id", "story_id", "source_id", "scope"), "id").withColumn("score", F.length("sentence") / 320.0))
    ends = a.select("story_id").distinct().select(F.col("story_id").alias("x"), ((F.col("story_id") * 5 + 2) % 37).alias("y")).where("x <> y")
    edges = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().withColumn("sim", F.col("b") / 100.0)
    there = a.select(F.col("story_id").alias("a")).distinct()
    edges = edges.join(there, "a", "left_semi").join(there.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "sim")
    now = F.expr(f"timestamp '{NOW}'")
    r = views.story_records(story_facts(spark).select("story_id", "policy"), a, quotes, edges, delta.story_deltas(a, NOW, 7), now)
    told = lambda c, k: F.array_join(F.transform(c, lambda x: F.concat(x[k].cast("string"), F.lit(":"), x["n"].cast("string"))), ",")
    return r.select(
        "story_id", "articles", "independent", "evidence", "state_share", "last_24h", F.col("first.source_id").alias("first_source"), "policy",
        told("alignment", "label").alias("alignment"), told("bias", "label").alias("bias"), told("per_day", "day").alias("per_day"),
        F.array_join(F.transform("sources", lambda x: x["id"].cast("string")), ",").alias("listed"),
        F.array_join(F.transform("related", lambda x: F.concat(x["other"].cast("string"), F.lit(":"), x["articles"].cast("string"))), ",").alias("related"),
        "delta.curr", "delta.prev", "delta.state", "delta.scope_shift",
    )


#: Conflict events of three desks: (desk, name in the place, name in the title, geo); what their addresses end with.
FIGHT = [("hungary", "budapest", "hungary", "hu"), ("poland", "warsaw", "poland", "pl"), ("serbia", "belgrade", "serbia", "rs")]
ENDS, TITLES, SITES = ["hu", "pl", "com", "rs", "org"], ["Clash in Hungary", "Poland strikes", "Serbia and Hungary talk", "Nothing"], ["Budapest", "Warsaw", "Belgrade", "Hungary", "Nowhere"]
EVENT = f"""ev AS (SELECT event_id, {TITLES!r}[CAST(event_id % 4 AS INTEGER) + 1] AS title, {SITES!r}[CAST(event_id % 5 AS INTEGER) + 1] AS place,
  'https://www.site' || event_id % 17 || '.' || {ENDS!r}[CAST(event_id % 17 % 5 AS INTEGER) + 1] || '/a/' || event_id % 700 AS url, 'site' || event_id % 17 || '.' || {ENDS!r}[CAST(event_id % 17 % 5 AS INTEGER) + 1] AS domain, ts,
  CASE WHEN event_id % 3 > 0 THEN repeat('x', CAST(event_id % 400 AS INTEGER)) END AS text FROM events),
al AS (SELECT *, unnest([{", ".join(f"{{'desk': '{d}', 'geo': '{g}', 'prio': CASE WHEN lower(place) = '{p}' THEN 3 WHEN contains(lower(title), '{t}') THEN 1 ELSE 0 END, 'hit': contains(lower(title || ' ' || place), '{t}') OR lower(place) = '{p}'}}" for d, p, t, g in FIGHT)}]) AS d FROM ev),
met AS (SELECT event_id, title, place, url, domain, ts, text, d.desk AS country, d.geo AS geo FROM al WHERE d.hit QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY d.prio DESC, d.desk) = 1),
out AS (SELECT 's' || range AS id, range AS place, ['hungary', 'poland', 'serbia'][CAST(range % 3 AS INTEGER) + 1] AS country, 'site' || range || '.' || {ENDS!r}[CAST(range % 5 AS INTEGER) + 1] AS domain FROM range(6)),
w AS (SELECT met.*, o.id AS oid, coalesce(o.place < 3, false) AS own, CASE WHEN o.place < 3 THEN o.id ELSE 'gdelt:' || met.domain END AS source_id,
  CASE WHEN o.id IS NOT NULL THEN 'abroad_local' WHEN ends_with(met.domain, '.' || geo) THEN 'domestic' ELSE 'international' END AS scope
  FROM met LEFT JOIN out o ON o.country = met.country AND o.domain = met.domain)"""


def _conflicts(spark, sf_dir):
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    host = F.concat(F.lit("site"), (i % 17).cast("string"), F.lit("."), pick(ENDS, i % 17))
    ev = e.select(
        "event_id", pick(TITLES, i).alias("title"), pick(SITES, i).alias("place"), F.concat(F.lit("https://www."), host, F.lit("/a/"), (i % 700).cast("string"), F.lit("?utm_source=x")).alias("url"),
        F.col("ts").alias("at"), F.lit(None).cast("string").alias("site"), F.lit("").alias("lead"), F.when(i % 3 > 0, F.expr("repeat('x', cast(event_id % 400 as int))")).alias("text"),
    ).withColumn("blob", F.concat_ws(" ", "title", "place"))
    word = lambda *w: r"(?i)\b(?:" + "|".join(w) + r")\b"
    desks = spark.createDataFrame([(d, word(p, t), word(p), None, word(t), g) for d, p, t, g in FIGHT], "desk string, any_re string, primary_re string, regional_re string, country_re string, geo string")
    k = F.col("id")
    outlets = spark.range(6).select(pick([d for d, *_ in FIGHT], k).alias("country"), k.alias("place"), F.concat(F.lit("s"), k.cast("string")).alias("id"),
        F.concat(F.lit("https://www.site"), k.cast("string"), F.lit("."), pick(ENDS, k), F.lit("/")).alias("homepage"), F.lit("en").alias("language"), F.lit("abroad_local").alias("scope"))
    none = F.lit("unrated")
    known = outlets.where("place < 3").select("id", F.col("id").alias("name"), "homepage", "language", "scope", none.alias("bias"), none.alias("alignment"), none.alias("factuality"))
    first = F.concat(F.lit("gdelt:site"), F.lit("7.com")).alias("id")
    known = known.unionByName(spark.range(1).select(first, F.lit("old").alias("name"), F.lit("https://site7.com").alias("homepage"), F.lit("hu").alias("language"), F.lit("international").alias("scope"), none.alias("bias"), none.alias("alignment"), none.alias("factuality")))
    old = e.where("event_id % 2 = 0 and event_id < 5000").select(
        F.concat(F.lit("https://www."), host, F.lit("/a/"), (i % 700).cast("string")).alias("url"), "event_id").groupBy("url").agg(F.min("event_id").alias("n"))
    old = old.select("url", F.lit("s").alias("source_id"), F.lit("hungary").alias("country"), F.lit("old").alias("title"), F.lit("").alias("lead"), F.when(F.col("n") % 4 == 0, "kept").alias("text"),
        F.lit("hu").alias("language"), F.expr("timestamp '2024-01-01'").alias("at"), F.lit("pending").alias("status"), F.lit(False).alias("relevant"))
    return events.merge_conflicts(ev, desks, outlets, known, old)


@query(f"""WITH {EVENT}, n AS (SELECT source_id, min_by(domain, event_id) AS name, min_by(scope, (CASE scope WHEN 'domestic' THEN 0 WHEN 'international' THEN 2 ELSE 1 END, event_id)) AS scope FROM w WHERE NOT own GROUP BY 1),
o AS (SELECT id, id AS name, 'abroad_local' AS scope FROM out WHERE place < 3 UNION ALL SELECT 'gdelt:site7.com', 'old', 'international')
SELECT coalesce(o.id, n.source_id) AS id, coalesce(o.name, n.name) AS name, CASE WHEN o.id IS NULL OR o.scope = 'international' AND n.scope IS NOT NULL OR n.scope = 'domestic' THEN n.scope ELSE o.scope END AS scope
FROM o FULL JOIN n ON n.source_id = o.id""")
def conflict_sources(spark, sf_dir):
    return _conflicts(spark, sf_dir)[0].select("id", "name", "scope")


@query(f"""WITH {EVENT}, o AS (SELECT 'https://www.site' || event_id % 17 || '.' || {ENDS!r}[CAST(event_id % 17 % 5 AS INTEGER) + 1] || '/a/' || event_id % 700 AS url, min(event_id) AS n FROM events WHERE event_id % 2 = 0 AND event_id < 5000 GROUP BY 1),
a AS (SELECT url, CASE WHEN n % 4 = 0 THEN 'kept' END AS text FROM o),
n AS (SELECT url, min_by(source_id, event_id) AS source_id, min_by(country, event_id) AS country, min(event_id) AS first, min(event_id) FILTER (text IS NOT NULL) AS told FROM w GROUP BY 1),
m AS (SELECT n.*, f.text AS first_text, t.text AS any_text FROM n JOIN ev f ON f.event_id = n.first LEFT JOIN ev t ON t.event_id = n.told)
SELECT coalesce(a.url, m.url) AS url, CASE WHEN a.url IS NOT NULL THEN 's' ELSE m.source_id END AS source_id, CASE WHEN a.url IS NOT NULL THEN 'hungary' ELSE m.country END AS country,
  length(coalesce(a.text, m.any_text)) AS size, m.url IS NOT NULL AS relevant,
  CASE WHEN a.url IS NOT NULL AND a.text IS NULL AND m.any_text IS NOT NULL THEN 'ok' WHEN a.url IS NOT NULL THEN 'pending'
    WHEN length(first_text) > 200 OR first_text IS NULL AND any_text IS NOT NULL THEN 'ok' ELSE 'pending' END AS status
FROM a FULL JOIN m ON m.url = a.url""")
def conflict_articles(spark, sf_dir):
    return _conflicts(spark, sf_dir)[1].select("url", "source_id", "country", F.length("text").cast("long").alias("size"), "relevant", "status")
