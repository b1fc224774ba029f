"""Named queries of intake, pools and directories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import intake
from .fixtures import ARTICLE, NOW, articles, read
from .queries import query


def now():
    return F.lit(NOW).cast("timestamp")


@query(f"SELECT event_id FROM events WHERE event_id % 3 = 0 OR ts + to_hours(CAST(event_id % 50 AS INTEGER)) <= TIMESTAMP '{NOW}'")
def due_feeds(spark, sf_dir):
    i = F.col("event_id")
    e = read(spark, sf_dir, "events").withColumn("retry_after", F.when(i % 3 != 0, F.expr("ts + make_dt_interval(0, cast(event_id % 50 as int))")))
    return intake.due_feeds(e, now()).select("event_id")


@query(f"WITH {ARTICLE} SELECT id FROM article WHERE trim(coalesce(title, '')) <> '' AND id % 5 <> 0")
def items_with_link(spark, sf_dir):
    a = articles(spark, sf_dir).withColumn("url", F.when(F.col("id") % 5 != 0, F.col("url")))
    return intake.with_link(a).select("id")


@query(f"""WITH {ARTICLE} SELECT id FROM article WHERE scope <> 'international' OR regexp_matches(title || ' ' || coalesce(lead, ''), CASE country WHEN 'en' THEN 'the |and ' WHEN 'fr' THEN ' le | la ' END)""")
def mention_gate(spark, sf_dir):
    packs = spark.createDataFrame([("en", "the |and "), ("fr", " le | la ")], "country string, pattern string")
    return intake.mentioned(articles(spark, sf_dir), packs).select("id")


@query("""WITH p AS (SELECT page_id AS id, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS country, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') AS domain FROM pages),
k AS (SELECT country, domain, min(id) AS id FROM p WHERE id % 7 = 0 AND domain <> '' GROUP BY ALL)
SELECT p.id, coalesce('s' || k.id, 'gdelt:' || p.domain) AS source_id FROM p LEFT JOIN k USING (country, domain) WHERE p.domain <> ''""")
def event_sources(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 2 == 0, "a").otherwise("b").alias("country"), "url")
    s = p.where("id % 7 = 0").select("country", F.col("url").alias("homepage"), F.col("id").alias("place"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"))
    return intake.source_of(p, s).select("id", "source_id")


DESKS = [("north", ["the", "South Korea"], ["is", "Seoul"]), ("south", ["der", "die", "new Zealand"], ["und", "von"]), ("west", ["le", "la", "côte d'ivoire"], ["de", "les"]), ("east", ["日本"], ["東京"])]
PLACES = ["", " In South  Korea", " south korea: talks", " Southkorea", " New Zealand's", " the Côte d'Ivoire", " 在日本的", " Seoul_"]
_ANY = lambda words: "(?:^|[^\\p{L}\\p{N}_])(?:" + "|".join(w.lower() for w in words).replace("'", "''") + ")(?:[^\\p{L}\\p{N}_]|$)"
_HAS = lambda c, words: f"contains({c}, '{words[0]}')" if words[0] in ("日本", "東京") else f"regexp_matches({c}, '{_ANY(words)}')"
_QUOTED = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in PLACES) + "]"
_EITHER = lambda c, n, t: f"({_HAS(c, n)} OR {_HAS(c, t)})"


@query(f"""WITH {ARTICLE}, w AS (SELECT id, lower(title || {_QUOTED}[CAST(id % {len(PLACES)} AS INTEGER) + 1]) AS t, lower(coalesce(lead, '') || {_QUOTED}[CAST(id % 5 AS INTEGER) + 1]) AS p FROM article)
{" UNION ALL ".join(f"SELECT id, '{d}' AS desk FROM w WHERE {_HAS('t', n)} OR ({_HAS('p', n)} AND {_EITHER('t', n, t)})" for d, n, t in DESKS)}""")
def event_desks(spark, sf_dir):
    d = spark.createDataFrame(DESKS, "desk string, names array<string>, terms array<string>")
    place = lambda n: F.element_at(F.array(*map(F.lit, PLACES)), (F.col("id") % n + 1).cast("int"))
    a = articles(spark, sf_dir).select("id", F.concat("title", place(len(PLACES))).alias("title"), F.concat(F.coalesce("lead", F.lit("")), place(5)).alias("place"))
    return intake.desks_of(a, d)


@query("SELECT event_id AS id FROM events ORDER BY event_id % 4 = 0 DESC, event_type IN ('click', 'view') DESC, CAST(ts AS DATE) DESC, event_id LIMIT 55")
def event_candidates(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "19").otherwise("14")
    return intake.candidates(e.select(F.col("event_id").alias("id"), (F.col("event_id") % 4 == 0).alias("known"), kind.alias("kind"), F.col("ts").alias("at"))).select("id")


@query(f"""WITH {ARTICLE} SELECT id, CAST(row_number() OVER (PARTITION BY country ORDER BY id % 3 DESC, id % 5 DESC, similarity DESC, id) AS INTEGER) AS rn FROM article QUALIFY rn <= 6""")
def best_posts(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", "country", (F.col("id") % 3).alias("hit"), (F.col("id") % 5).alias("weight"), F.col("similarity").alias("sim"))
    return intake.best_posts(a).select("id", "rn")


@query("SELECT c_custkey, r_name AS desk FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey OR r_regionkey = (n_regionkey + 1) % 5")
def owner_fan_out(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    owners = n.crossJoin(F.broadcast(r)).where("r_regionkey = n_regionkey or r_regionkey = (n_regionkey + 1) % 5").select(F.lower("n_name").alias("geo"), F.col("r_name").alias("desk"))  # 25 by 5 rows
    c = read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("geo"))
    return intake.fan_out(c, owners, "geo").select("c_custkey", "desk")


@query(f"""WITH {ARTICLE} SELECT id, CASE WHEN id % 2 = 0 AND lead <> '' THEN lead ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END AS title, CASE WHEN id % 2 = 0 AND lead <> '' THEN '' ELSE lead END AS summary FROM article""")
def event_items(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "UK travel advice").otherwise("USGS").alias("kind"), "title", F.col("lead").alias("summary"), "url", F.lit(None).cast("string").alias("level"), "at")
    return intake.event_items(a).select("id", "title", "summary")


@query(f"""WITH {ARTICLE}, p AS (SELECT id, CASE WHEN id % 3 = 0 THEN url END AS url, CASE WHEN id % 3 = 1 THEN title END AS title, country FROM article)
SELECT min(id) AS id FROM p GROUP BY coalesce(nullif(url, ''), nullif(title, '') || '|' || country, CAST(id AS VARCHAR))""")
def story_pool(spark, sf_dir):
    i = F.col("id")
    a = articles(spark, sf_dir).select("id", F.when(i % 3 == 0, F.col("url")).alias("url"), F.when(i % 3 == 1, F.col("title")).alias("title"), "country")
    return intake.pool(a, [F.asc("id")]).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 4 = 0")
def industry_filter(spark, sf_dir):
    themes = F.when(F.col("p_partkey") % 4 == 0, F.array(F.lit("industry"))).otherwise(F.array(F.lit("trade")))
    return intake.industry(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), themes.alias("themes")), "industry").select("id")


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 2 = 0),
n AS (SELECT o_orderkey AS id, o_orderpriority AS status FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(o.status, n.status) AS status FROM o FULL JOIN n ON o.id = n.id""")
def upsert_keep_old(spark, sf_dir):
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = o.where(k % 2 == 0).select(k.alias("id"), F.when(k % 3 == 0, F.col("o_orderstatus")).alias("status"))
    return intake.keep_old(old, o.where(k % 5 == 0).select(k.alias("id"), F.col("o_orderpriority").alias("status")), "id")


@query("""WITH n AS (SELECT l_orderkey AS id, max(l_linenumber) AS line FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)
SELECT o_orderkey AS id, 0 AS line FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n) UNION ALL SELECT id, CAST(line AS INTEGER) FROM n""")
def insert_or_replace(spark, sf_dir):
    old = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("line"))
    new = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("line"))
    return intake.replace(old, new, "id", [F.desc("line")])


def _directory_sql(by: str) -> str:
    order = "".join(f"{c} DESC, " for c in intake.DIRECTORY[by])
    return f"""WITH d AS (SELECT n_name AS name, n_nationkey % 3 AS alerts, n_nationkey % 2 AS elections, n_nationkey % 4 AS surging, n_nationkey % 5 AS stories_24h, n_nationkey % 7 AS stories_7d FROM nation)
SELECT name, CAST(row_number() OVER (ORDER BY {order}name) AS INTEGER) AS place FROM d"""


def _directory(by: str):
    def run(spark, sf_dir):
        k = F.col("n_nationkey")
        facts = (("alerts", 3), ("elections", 2), ("surging", 4), ("stories_24h", 5), ("stories_7d", 7))
        return intake.directory(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), *((k % m).alias(c) for c, m in facts)), by).select("name", "place")

    run.__name__ = f"desk_directory_{by}"
    return run


for _by in intake.DIRECTORY:
    query(_directory_sql(_by))(_directory(_by))


@query("""SELECT o_orderpriority AS country, o_custkey % 2 AS window_days, count(*) AS total, count(*) FILTER (o_orderkey % 11 >= 8) AS high, count(*) FILTER (o_orderkey % 11 <= 2) AS low FROM orders GROUP BY ALL""")
def policy_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return intake.policy_counts(o.select(F.col("o_orderpriority").alias("country"), (F.col("o_custkey") % 2).alias("window_days"), (F.col("o_orderkey") % 11 / 10).alias("policy")))


@query("SELECT label, count(event_id) AS n FROM (VALUES ('all'), ('click'), ('view'), ('none')) AS l(label) LEFT JOIN events ON label = 'all' OR label = event_type GROUP BY 1")
def tab_counts(spark, sf_dir):
    return intake.tab_counts(read(spark, sf_dir, "events"), "event_type", ["click", "view", "none"])


@query()
def event_labels(spark, sf_dir):
    a = articles(spark, sf_dir)
    told = F.concat_ws(" ", "title", "lead")
    return a.select("id", patterns.disaster_label(told, F.array("category")).alias("disaster"), patterns.violence_label(told, F.array("category")).alias("violence"), patterns.sports_spam(F.col("title"), F.col("source_id"), F.col("url")).alias("spam"))
