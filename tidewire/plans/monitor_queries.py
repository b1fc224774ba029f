"""Named queries of the event monitor, of quoted sentences and of the country index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import vectors
from ..operators import catalog, excerpts, monitor
from .fixtures import ARTICLE, articles, read
from .queries import query

# Titles of the tables hold no words of events: each gets the words that its id picks, and so do two outlets' titles.
SAID = [
    "", "Flood near the mosque", "Militants attack a church", "Rabbi speaks", "Airstrike on the harbour", "Protest at the festival", "Mosque raid kills two", "Árvíz a völgyben",
    "Earthquake", "Riot police and a synagogue bombed", "Concert in the cathedral", "Shot fired", "Typhoon and typhoons", "Yazidi villages shelled",
]
THEMES = [["Trade"], ["Regional security"], ["Sport and culture"], ["Civil unrest and armed conflict"], []]
CATEGORY = ["other", "defence_security", "other", "sport_culture", "other", "other", "economy"]


def _pick_sql(by: str, values: list) -> str:
    return f"{values!r}[CAST(({by}) % {len(values)} AS INTEGER) + 1]"


def _pick(by, values):
    return F.element_at(F.array(*(F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v) for v in values)), (by % len(values) + 1).cast("int"))


STORY = f"""{ARTICLE}, st AS (SELECT id, country, tm AS last_seen, title || ' ' || {_pick_sql('id', SAID)} AS title,
  [{_pick_sql('id // 3', SAID)}, {_pick_sql('id // 7', SAID)}] AS titles, {_pick_sql('id // 2', THEMES)} AS themes, {_pick_sql('id // 5', CATEGORY)} AS category,
  CASE WHEN id % 19 = 0 THEN 'Storm & Cyclone' END AS disaster_type FROM article)"""


def _stories(spark, sf_dir):
    a, i = articles(spark, sf_dir), F.col("id")
    part = lambda n: F.floor(i / n).cast("long")
    none = F.lit(None)
    return a.select(
        i, "country", F.col("at").alias("last_seen"), F.concat_ws(" ", "title", _pick(i, SAID)).alias("title"), none.cast("string").alias("en_title"),
        F.array(_pick(part(3), SAID), _pick(part(7), SAID)).alias("titles"), _pick(part(2), THEMES).alias("themes"), _pick(part(5), CATEGORY).alias("category"),
        F.when(i % 19 == 0, "Storm & Cyclone").alias("disaster_type"), none.cast("string").alias("violence_type"), none.cast("array<string>").alias("traditions"),
    )


def _re(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def _label(c: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN {_re(c, p)} THEN '{label}'" for label, p in rules) + " END"


def _labels(c: str, rules) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_re(c, p)} THEN '{label}' END" for label, p in rules) + "], lambda z: z IS NOT NULL)"


FOLD = "strip_accents(lower({}))"
TAGGED = f"""{STORY}, f AS (SELECT *, {FOLD.format('title')} AS t0, {FOLD.format('titles[1]')} AS t1, {FOLD.format('titles[2]')} AS t2, lower(array_to_string(themes, ' ')) AS th FROM st),
g AS (SELECT *, t0 || ' ' || t1 || ' ' || t2 AS lead, category = 'sport_culture' OR contains(th, 'sport') OR contains(th, 'culture') OR contains(th, 'entertainment') AS leave FROM f),
h AS (SELECT *, {", ".join(f"CASE WHEN {_re(t, fixed.HARM)} AND NOT {_re(t, fixed.ARTS_OR_SPORT)} THEN {_labels(t, fixed.FAITHS)} ELSE [] END AS r{t[1]}" for t in ("t0", "t1", "t2"))} FROM g),
tagged AS (SELECT id, last_seen, title, themes, lead, leave, CASE WHEN leave OR disaster_type IS NOT NULL THEN disaster_type ELSE {_label('lead', fixed.FOLDED_DISASTERS)} END AS disaster,
  CASE WHEN NOT leave AND NOT {_re('lead', fixed.ARTS_OR_SPORT)} THEN coalesce({_label('lead', fixed.FOLDED_VIOLENCE)},
    CASE WHEN {_re('lead', fixed.HARM)} AND (category = 'defence_security' OR regexp_matches(th, 'security|conflict|violence')) THEN 'Armed Clash & Strike' END) END AS violence,
  CASE WHEN leave THEN NULL WHEN len(r0) > 0 THEN r0 WHEN len(r1) > 0 THEN r1 WHEN len(r2) > 0 THEN r2 END AS faiths FROM h)"""


@query(f"WITH {TAGGED} SELECT id, disaster, violence, array_to_string(coalesce(faiths, ['none']), '|') AS faiths FROM tagged")
def event_tags(spark, sf_dir):
    t = monitor.tagged(_stories(spark, sf_dir))
    faiths = F.concat_ws("|", F.coalesce("traditions", F.array(F.lit("none")))).alias("faiths")
    return t.select("id", F.col("disaster_type").alias("disaster"), F.col("violence_type").alias("violence"), faiths)


_FAITH_SQL = ", ".join(f"CASE WHEN list_contains(faiths, '{label}') THEN '{name}' END" for name, label in monitor.FAITH_TRACKS.items())
_CLASH_SQL = ", ".join(
    f"CASE WHEN NOT {_re('lead', fixed.ARTS_OR_SPORT)} AND (coalesce(violence = '{label}', false) OR {_re('lead', monitor.VIOLENCE[label])}) THEN '{name}' END"
    for name, label in monitor.TRACKS.items()
)


@query(f"""WITH {TAGGED}, x AS (SELECT id, unnest([CASE WHEN len(faiths) > 0 THEN 'rel_all' END, {_FAITH_SQL}, {_CLASH_SQL}]) AS track FROM tagged)
SELECT track, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM x WHERE track IS NOT NULL GROUP BY 1""")
def conflict_tracks(spark, sf_dir):
    t = monitor.tracks(monitor.tagged(_stories(spark, sf_dir)))
    return t.select("id", F.explode("tracks").alias("track")).groupBy("track").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_ALERT = "a AS (SELECT id, {} AS t FROM article)".format(FOLD.format(f"country || '  ' || category || ' ' || {_pick_sql('id', SAID)} || ' ' || {_pick_sql('id // 5', SAID)}"))
_ALERT_FAITHS = ", ".join(f"CASE WHEN {_re('t', fixed.HARM)} AND {_re('t', p)} THEN '{name}' END" for name, (_, p) in zip(monitor.FAITH_TRACKS, fixed.FAITHS))


@query(f"""WITH {ARTICLE}, {_ALERT}, b AS (SELECT id, [{_ALERT_FAITHS}] AS r, [{", ".join(f"CASE WHEN {_re('t', monitor.VIOLENCE[label])} THEN '{name}' END" for name, label in monitor.TRACKS.items())}] AS v
  FROM a WHERE NOT {_re('t', fixed.ARTS_OR_SPORT)}),
x AS (SELECT id, unnest(list_concat([CASE WHEN len(list_filter(r, lambda z: z IS NOT NULL)) > 0 THEN 'rel_all' END], r, v)) AS track FROM b)
SELECT track, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM x WHERE track IS NOT NULL GROUP BY 1""")
def alert_tracks(spark, sf_dir):
    a, i = articles(spark, sf_dir), F.col("id")
    said = _pick(F.floor(i / 5).cast("long"), SAID)
    a = a.select("id", F.col("country").alias("country_name"), F.lit(None).cast("string").alias("region"), F.col("category").alias("kind"), _pick(i, SAID).alias("title"), said.alias("summary"))
    return monitor.alert_tracks(a).select("id", F.explode("tracks").alias("track")).groupBy("track").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _pool_sql(mode: str, keep: str) -> str:
    return f"""SELECT '{mode}' AS mode, id, max(last_seen) AS last_seen FROM tagged WHERE NOT leave AND last_seen >= TIMESTAMP '2024-01-10 00:00:00' AND ({keep}) GROUP BY id"""


@query(f"""WITH {TAGGED} {_pool_sql("disasters", "disaster IS NOT NULL")} UNION ALL
{_pool_sql("violence", f"violence IS NOT NULL OR len(faiths) > 0 OR list_has_any(themes, {monitor.VIOLENT!r})")}""")
def event_pools(spark, sf_dir):
    s, since = _stories(spark, sf_dir), F.lit("2024-01-10").cast("timestamp")
    lists = [s.where("id % 10 = 3"), s.where("id % 4 = 1"), s]  # the lists of the page, then all stories of all countries
    pools = [monitor.event_pool(lists, mode, since).select(F.lit(mode).alias("mode"), "id", "last_seen") for mode in ("disasters", "violence")]
    return pools[0].unionByName(pools[1])


@query(f"""WITH {ARTICLE}, n AS (SELECT count(*) AS n FROM embeddings),
told AS (SELECT a.* FROM article a WHERE similarity >= 0.93 AND text IS NOT NULL AND syndicated_of IS NULL),
mv AS (SELECT story_id, embedding FROM told JOIN embeddings ON vec_id = id % (SELECT n FROM n)),
mx AS (SELECT story_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM mv),
mm AS (SELECT story_id, p, avg(v) AS m FROM mx GROUP BY 1, 2),
ce AS (SELECT story_id, list(m ORDER BY p) AS c, sqrt(sum(m * m)) AS norm FROM mm GROUP BY 1),
se AS (SELECT id, story_id, source_id, scope, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM told),
q AS (SELECT se.*, list_dot_product(CAST(embedding AS DOUBLE[]), c) / norm + CASE WHEN (id + ord) % 3 = 0 OR regexp_matches(line, {"'" + '["“”«»「」『』]' + "'"}) THEN 0.02 ELSE 0 END AS score
  FROM se JOIN embeddings ON vec_id = (id * 5 + ord) % (SELECT n FROM n) JOIN ce USING (story_id) WHERE ord > 0),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY story_id, source_id ORDER BY round(score, 9) DESC, id, ord) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY story_id, scope ORDER BY round(score, 9) DESC, id) AS o FROM b)
SELECT story_id, id, CAST(ord AS INTEGER) AS ord, row_number() OVER (PARTITION BY story_id ORDER BY (o > 1)::INT, round(score, 9) DESC, id) AS place FROM o
QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY (o > 1)::INT, round(score, 9) DESC, id) <= 3""")
def excerpt_choice(spark, sf_dir):
    a, e = articles(spark, sf_dir), read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    n = F.lit(e.count())
    members = a.select("story_id", "id", "similarity", "text", "syndicated_of", (F.col("id") % n).alias("vec_id")).join(e, "vec_id")
    lines = a.select("id", "story_id", "source_id", "scope", F.posexplode(F.split("text", "\n")).alias("ord", "line")).where("ord > 0")
    said = F.when((F.col("id") + F.col("ord")) % 3 == 0, F.concat(F.lit("It was said that "), "line")).otherwise(F.col("line"))
    lines = lines.select("id", "story_id", "source_id", "scope", "ord", said.alias("sentence"), ((F.col("id") * 5 + F.col("ord")) % n).alias("vec_id")).join(e, "vec_id")
    scored = excerpts.scored(lines, members).withColumn("score", F.round("score", 9))
    return excerpts.choose(scored).select("story_id", "id", "ord", F.col("place").cast("long").alias("place"))


@query("""WITH c AS (SELECT lower(n_name) AS id, n_name AS name, CASE WHEN n_nationkey % 6 <> 0 THEN r_name END AS region,
    [upper(n_name), p.one, p.two] AS mention FROM nation JOIN region ON r_regionkey = n_regionkey
    JOIN (SELECT s_nationkey, min(s_name) AS one, max(s_name) AS two FROM supplier GROUP BY 1) p ON s_nationkey = n_nationkey),
p AS (SELECT DISTINCT lower(n_name) AS id, CASE WHEN c_custkey % 2 = 0 THEN 'week' ELSE 'day' END AS period, CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 1 END AS days
  FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 5 <> 0 AND (n_nationkey % 3 <> 0 OR c_custkey % 2 = 1))
SELECT c.id, any_value(name) AS name, coalesce(any_value(region), 'Other') AS region, any_value(lower(name) || '|' || lower(mention[2]) || CASE WHEN mention[2] <> mention[3] THEN '|' || lower(mention[3]) ELSE '' END) AS mentions,
  string_agg(period || ':' || c.id || '-' || period || '.json', '|' ORDER BY days DESC) AS periods FROM c JOIN p ON p.id = c.id GROUP BY c.id""")
def country_index(spark, sf_dir):
    n, r, s, c = (read(spark, sf_dir, t) for t in ("nation", "region", "supplier", "customer"))
    key, none = F.col("n_nationkey"), F.lit(None).cast("string")
    known = s.groupBy("s_nationkey").agg(F.min("s_name").alias("one"), F.max("s_name").alias("two"))
    countries = n.join(r, F.col("r_regionkey") == F.col("n_regionkey")).join(known, F.col("s_nationkey") == key).select(
        F.lower("n_name").alias("id"), F.col("n_name").alias("name"), F.when(key % 6 != 0, F.col("r_name")).alias("region"), none.alias("language"), none.alias("abroad_label"),
        F.array(F.upper("n_name"), "one", "two").alias("mention"))
    week = F.col("c_custkey") % 2 == 0
    periods = c.join(n, key == F.col("c_nationkey")).where((key % 5 != 0) & ((key % 3 != 0) | ~week)).select(
        F.lower("n_name").alias("id"), F.when(week, "week").otherwise("day").alias("period"), F.when(week, "This week").otherwise("Today").alias("label"), F.when(week, 7).otherwise(1).alias("days"))
    shown = F.concat_ws("|", F.transform("periods", lambda p: F.concat(p["id"], F.lit(":"), p["file"])))
    return catalog.country_index(countries, periods).select("id", "name", "region", F.concat_ws("|", "mentions").alias("mentions"), shown.alias("periods"))
