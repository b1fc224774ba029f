"""Named queries of feeds, catalogs and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import patterns, text
from ..operators import catalog, excerpts, feeds, ranking, stories, views
from .fixtures import ARTICLE, NOW, articles, read
from .queries import COVERAGE, query, scored

BOUND = r"(^|[^\p{L}\p{N}_])"
END = r"($|[^\p{L}\p{N}_])"


def words_sql(terms):
    return BOUND + "(" + "|".join(terms) + ")" + END


def now():
    return F.lit(NOW).cast("timestamp")


@query(f"""WITH {ARTICLE}, s AS (SELECT id, country, category, title, CAST(id * 7919 % 1000 AS DOUBLE) AS score FROM article),
a AS (SELECT country, id, 0 AS part, row_number() OVER (PARTITION BY country ORDER BY score DESC, id) AS rn FROM s QUALIFY rn <= 10
  UNION ALL SELECT country, id, 1, row_number() OVER (PARTITION BY country, category ORDER BY score DESC, id) AS rn FROM s QUALIFY rn <= 3)
SELECT country, id, min(part) AS part, CAST(arg_min(rn, (part, rn)) AS INTEGER) AS rn FROM a GROUP BY 1, 2""")
def dashboard_ids(spark, sf_dir):
    s = articles(spark, sf_dir).withColumn("score", (F.col("id") * 7919 % 1000).cast("double"))
    return views.dashboard(s, 10, 3)


@query(f"""WITH {ARTICLE}, s AS (SELECT id, country, category, CAST(id * 7919 % 1000 AS DOUBLE) AS score, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS low FROM article)
SELECT country, id FROM s QUALIFY row_number() OVER (PARTITION BY country ORDER BY low, CASE WHEN category = 'other' THEN 1 ELSE 0 END, score DESC, id) = 1""")
def desk_leads(spark, sf_dir):
    s = articles(spark, sf_dir).withColumn("score", (F.col("id") * 7919 % 1000).cast("double")).withColumn("title", F.lit("Title"))
    return views.desk_leads(s.withColumn("themes", F.when(F.col("id") % 3 == 0, F.array(F.lit("Sport and culture"))).otherwise(F.array(F.lit("Trade")))))


@query(f"""WITH {ARTICLE}, s AS (SELECT id, country, category, CAST(id * 7919 % 1000 AS DOUBLE) AS score FROM article),
b AS (SELECT *, max(score) OVER (PARTITION BY country, category) AS best, row_number() OVER (PARTITION BY country, category ORDER BY score DESC, id) AS rn FROM s)
SELECT country, category, id, row_number() OVER (PARTITION BY country ORDER BY (category = 'other')::INT, best DESC, category, rn) AS place FROM b WHERE rn <= 4""")
def topic_pages(spark, sf_dir):
    s = articles(spark, sf_dir).withColumn("score", (F.col("id") * 7919 % 1000).cast("double"))
    return views.topics(s).withColumn("place", F.col("place").cast("long"))


@query("""WITH a AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_totalprice > 100000),
u AS (SELECT id, score, 'urgent' AS section, 0 AS s FROM a UNION ALL SELECT id, score, 'large', 1 FROM b), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY s) = 1)
SELECT id, section, place FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, id) AS place FROM o) WHERE place <= 9""")
def home_sections(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"), "o_orderpriority")
    a, b = o.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority"), o.where("score > 100000").drop("o_orderpriority")
    return views.unique_sections([("urgent", a, 9), ("large", b, 9)], [F.desc("score"), F.asc("id")]).select("id", "section", F.col("place").cast("long").alias("place"))


@query(f"""WITH {COVERAGE}, d AS (SELECT *, (story_id % 5) / 5.0 AS share FROM scored)
SELECT story_id, CASE WHEN share >= 0.7 THEN 'mostly state outlets' WHEN share >= 0.35 THEN 'mixed state and independent' WHEN scopes >= 2 THEN 'several perspectives'
  WHEN independent >= 2 THEN 'independent outlets' ELSE 'single source' END AS perspective FROM d""")
def perspective_labels(spark, sf_dir):
    return scored(spark, sf_dir).select("story_id", views.perspective(F.col("story_id") % 5 / 5.0, F.col("scopes"), F.col("independent")).alias("perspective"))


@query("""WITH s AS (SELECT event_type AS category, event_id % 7 AS curr, event_id % 5 AS prev, ['new', 'surging', 'cooling', 'steady', 'trace'][CAST(event_id % 5 AS INTEGER) + 1] AS state FROM events),
t AS (SELECT category, count(*) AS n FROM s GROUP BY 1)
SELECT CAST(sum(curr) AS BIGINT) AS curr, CAST(sum(prev) AS BIGINT) AS prev, count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'surging') AS surging, count(*) FILTER (state = 'cooling') AS cooling,
  count(*) FILTER (state = 'steady') AS steady, count(*) FILTER (state = 'trace') AS trace, (SELECT arg_max(category, (n, category)) FROM t) AS top, (SELECT round(100.0 * max(n) / CAST(sum(n) AS BIGINT), 6) FROM t) AS top_pct FROM s""")
def relations_panel(spark, sf_dir):
    i = F.col("event_id")
    names = F.array(*map(F.lit, ("new", "surging", "cooling", "steady", "trace")))
    e = read(spark, sf_dir, "events")
    s = e.select(F.col("event_type").alias("category"), (i % 7).alias("curr"), (i % 5).alias("prev"), F.element_at(names, (i % 5 + 1).cast("int")).alias("state"))
    return views.relations_panel(s).withColumn("top_pct", F.round("top_pct", 6))


@query(f"""WITH t AS (SELECT count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 1 DAY) AS n FROM events)
SELECT event_id FROM events, t WHERE ts >= CASE WHEN n > 0 THEN TIMESTAMP '{NOW}' - INTERVAL 1 DAY ELSE TIMESTAMP '{NOW}' - INTERVAL 7 DAY END ORDER BY ts DESC, event_id LIMIT 15""")
def newest_alerts(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return views.hot_alerts(e, now()).select(F.col("id").alias("event_id"))


@query("""WITH p AS (SELECT vec_id % 37 AS x, (vec_id * 3 + 1) % 37 AS y, (vec_id % 97) / 100.0 AS sim FROM embeddings),
e AS (SELECT least(x, y) AS a, greatest(x, y) AS b, max(sim) AS sim FROM p WHERE x <> y GROUP BY 1, 2),
x AS (SELECT a AS story_id, b AS other, sim FROM e UNION SELECT b, a, sim FROM e), s AS (SELECT range AS other, range * 2 AS articles FROM range(37))
SELECT story_id, other, articles, rn FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY sim DESC, other) AS rn FROM x JOIN s USING (other)) WHERE rn <= 2""")
def related_stories(spark, sf_dir):
    i = F.col("vec_id")
    e = read(spark, sf_dir, "embeddings").select((i % 37).alias("x"), ((i * 3 + 1) % 37).alias("y"), (i % 97 / 100.0).alias("sim")).where("x <> y")
    e = e.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("sim").alias("sim"))
    s = spark.range(37).select(F.col("id").alias("story_id"), (F.col("id") * 2).alias("articles"))
    return views.related(e, s).withColumn("rn", F.col("rn").cast("long"))


@query()
def story_documents(spark, sf_dir):
    a = articles(spark, sf_dir)
    q = excerpts.sentences(a.select("id", "text")).join(a.select("id", "story_id", "source_id", "scope"), "id").withColumn("score", F.length("sentence") / 320.0)
    return views.band_document(scored(spark, sf_dir), a, excerpts.choose(q)).withColumn("themes", F.to_json("themes"))


@query()
def brief_sections(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("category", F.element_at("themes", 1)).withColumn("title", F.concat(F.lit("Story "), F.col("story_id").cast("string")))
    s = s.withColumn("perspective", views.perspective(F.lit(0.0), F.col("scopes"), F.col("independent")))
    return views.markdown(ranking.top_per(s, ["category"], [F.desc("score"), F.asc("story_id")], 4, "place"))


@query()
def story_sample(spark, sf_dir):
    n = articles(spark, sf_dir).groupBy(F.col("story_id").alias("id")).agg(F.count("*").alias("n")).where("n >= 2")
    return views.sample(n, 30)


@query(f"""WITH {ARTICLE} SELECT CASE WHEN length(text) > 2000 THEN 'ok' WHEN lead = '' THEN 'empty' ELSE 'pending' END AS status, count(*) AS n FROM article GROUP BY 1""")
def status_histogram(spark, sf_dir):
    s = F.when(F.length("text") > 2000, "ok").when(F.col("lead") == "", "empty").otherwise("pending")
    return articles(spark, sf_dir).groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT label, round(median(x), 9) AS median, round(quantile_cont(x, 0.1), 9) AS p10 FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) GROUP BY 1")
def similarity_quantiles(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", F.element_at("embedding", 1).cast("double").alias("x"))
    return e.groupBy("label").agg(F.round(F.median("x"), 9).alias("median"), F.round(F.percentile("x", 0.1), 9).alias("p10"))


@query(f"""WITH {ARTICLE}, s AS (SELECT story_id, factuality, count(*) AS n FROM article WHERE factuality <> 'unrated' GROUP BY ALL)
SELECT story_id, array_to_string(list(factuality || ':' || n ORDER BY factuality), ',') AS histogram FROM s GROUP BY 1""")
def rating_histogram(spark, sf_dir):
    n = articles(spark, sf_dir).where("factuality <> 'unrated'").groupBy("story_id", "factuality").agg(F.count("*").alias("n"))
    h = n.groupBy("story_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("factuality", "n")))).alias("m"))
    return h.select("story_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("histogram"))


@query(f"""WITH {ARTICLE}, r AS (SELECT story_id, count(*) FILTER (country = 'en') * 2 > count(*) AS english FROM article GROUP BY 1) SELECT story_id, english FROM r""")
def english_majority(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("story_id").agg((F.count_if(F.col("country") == "en") * 2 > F.count("*")).alias("english"))


@query(f"""WITH {ARTICLE} SELECT country, id FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY similarity DESC, id) AS rn FROM article WHERE id NOT IN (SELECT doc_id FROM labels)) WHERE rn <= 150""")
def translation_queue(spark, sf_dir):
    a = articles(spark, sf_dir).join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")
    return ranking.top_per(a, ["country"], [F.desc("similarity"), F.asc("id")], 150).select("country", "id")


@query(f"""WITH {ARTICLE} SELECT story_id, min_by(category, (similarity, id)) AS category, (SELECT count(*) FROM article b WHERE b.story_id = a.story_id AND b.similarity >= 0.93) AS core FROM article a GROUP BY 1""")
def decorrelated_counts(spark, sf_dir):
    a = articles(spark, sf_dir)
    core = a.where("similarity >= 0.93").groupBy("story_id").agg(F.count("*").alias("core"))
    first = a.groupBy("story_id").agg(F.min_by("category", F.struct("similarity", "id")).alias("category"))
    return first.join(core, "story_id", "left").select("story_id", "category", F.coalesce("core", F.lit(0).cast("long")).alias("core"))


@query(f"""WITH {ARTICLE}, t AS (SELECT id, ['the', 'is'] AS a FROM article)
SELECT id, regexp_matches(lower(title), '{words_sql(["troops", "the", "clash"])}') AS armed, length(title) <= 190 AND length(regexp_replace(title, '[^;]', '', 'g')) < 3 AS short FROM article""")
def title_gates(spark, sf_dir):
    t = F.col("title")
    return articles(spark, sf_dir).select("id", feeds.has(t, ["troops", "the", "clash"]).alias("armed"), ((F.length(t) <= 190) & (F.length(F.regexp_replace(t, "[^;]", "")) < 3)).alias("short"))


ADVICE = ["armed gangs near the border", "cyclone season begins", "security warning", "terrorism alert", "routine visa notice", "civil Unrest expected", "kidnapping risk"]


@query(f"""WITH t AS (SELECT *, {ADVICE!r}[CAST(event_id % 7 AS INTEGER) + 1] AS title FROM events)
SELECT event_id, CASE WHEN event_id % 4 >= 3 THEN ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY
    WHEN event_id % 4 = 2 THEN ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND regexp_matches(lower(title), '\\b(terror|unrest|conflict|kidnap|armed|violence)\\b') ELSE false END AS kept,
  event_id % 3 <> 0 OR contains(title, 'cyclone') AS storm FROM t""")
def advisory_filter(spark, sf_dir):
    title = F.element_at(F.array(*map(F.lit, ADVICE)), (F.col("event_id") % len(ADVICE) + 1).cast("int"))
    level = F.when(F.col("event_id") % 3 == 0, "Green").otherwise("Red")
    return read(spark, sf_dir, "events").select("event_id", feeds.advisory_gate(F.col("event_id") % 4, F.col("ts"), title, now()).alias("kept"), feeds.storm_gate(level, title).alias("storm"))


@query("""WITH t AS (SELECT event_id, ['daily news', 'weather today', 'election result', 'harbour'][CAST(event_id % 4 AS INTEGER) + 1] AS term, CASE WHEN event_id % 5 = 0 THEN 'Headline' END AS news FROM events)
SELECT event_id, term NOT IN ('daily news') AND term NOT LIKE '%weather%' AND (contains(term, ' ') OR coalesce(news, '') <> '') AS kept FROM t""")
def trend_filter(spark, sf_dir):
    i = F.col("event_id")
    term = F.element_at(F.array(*map(F.lit, ("daily news", "weather today", "election result", "harbour"))), (i % 4 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", feeds.keep_trend(term, F.when(i % 5 == 0, "Headline"), ["daily news"], ["weather"]).alias("kept"))


@query("""WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'The Herald.com' WHEN s_suppkey % 4 = 1 THEN 'Daily Post Online' WHEN s_suppkey % 4 = 2 THEN 'x' ELSE 'Gazette' END AS name,
  CASE WHEN s_suppkey % 8 = 2 THEN 'press.gov.mt' ELSE 'x.org' END AS domain, s_suppkey % 16 = 6 AS state FROM supplier)
SELECT id, CASE WHEN name = 'Gazette' THEN 'left' WHEN name = 'The Herald.com' THEN 'center' WHEN name = 'Daily Post Online' THEN 'right' WHEN domain = 'press.gov.mt' THEN 'center' ELSE 'unrated' END AS bias,
  CASE WHEN name IN ('Gazette', 'The Herald.com', 'Daily Post Online') THEN 'independent' WHEN domain = 'press.gov.mt' THEN 'official' WHEN state THEN 'state_controlled' ELSE 'unrated' END AS alignment FROM s""")
def outlet_ratings(spark, sf_dir):
    i = F.col("s_suppkey")
    name = F.when(i % 4 == 0, "The Herald.com").when(i % 4 == 1, "Daily Post Online").when(i % 4 == 2, "x").otherwise("Gazette")
    s = read(spark, sf_dir, "supplier").select(i.alias("id"), name.alias("name"), F.when(i % 8 == 2, "press.gov.mt").otherwise("x.org").alias("domain"), (i % 16 == 6).alias("state_affiliated"))
    r = spark.createDataFrame([(1, "Gazette", "left", "independent", "high"), (2, "Herald", "center", "independent", "high"), (3, "Daily Post", "right", "independent", "mixed")], "ord int, name string, bias string, alignment string, factuality string")
    return catalog.rate(s, r).select("id", "bias", "alignment")


@query("""WITH b AS (SELECT event_type AS id, event_type AS label, CAST(count(*) AS DOUBLE) AS weight, list_sort(list(DISTINCT 'w' || event_id % 5)) AS kw FROM events WHERE event_id % 2 = 0 GROUP BY 1),
e AS (SELECT CASE WHEN event_type = 'error' THEN 'fault' ELSE event_type END AS id, NULL AS label, CAST(max(event_id) AS DOUBLE) AS weight, list_sort(list(DISTINCT 'w' || event_id % 8)) AS kw FROM events WHERE event_id % 2 = 1 AND event_type <> 'click' GROUP BY 1)
SELECT coalesce(b.id, e.id) AS id, coalesce(e.label, b.label) AS label, coalesce(e.weight, b.weight) AS weight,
  array_to_string(list_concat(coalesce(b.kw, []), list_filter(coalesce(e.kw, []), lambda w: NOT list_contains(coalesce(b.kw, []), w))), ',') AS keywords FROM b FULL JOIN e ON e.id = b.id""")
def theme_merge(spark, sf_dir):
    ev, i = read(spark, sf_dir, "events"), F.col("event_id")
    words = lambda n: F.sort_array(F.collect_set(F.concat(F.lit("w"), (i % n).cast("string")))).alias("keywords")
    none = F.lit(None).cast("string")
    b = ev.where("event_id % 2 = 0").groupBy(F.col("event_type").alias("id")).agg(F.first("event_type").alias("label"), F.count("*").cast("double").alias("weight"), F.first(none).alias("category"), words(5))
    e = ev.where("event_id % 2 = 1 AND event_type <> 'click'").groupBy(F.when(F.col("event_type") == "error", "fault").otherwise(F.col("event_type")).alias("id"))
    e = e.agg(F.first(none).alias("label"), F.max(i).cast("double").alias("weight"), F.first(none).alias("category"), words(8))
    return catalog.merged_themes(b, e).select("id", "label", "weight", F.array_join("keywords", ",").alias("keywords"))


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'Own' WHEN n_nationkey % 3 = 1 THEN r_name ELSE 'Other' END AS region FROM nation JOIN region ON r_regionkey = n_regionkey""")
def country_regions(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    fixed = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 3 = 1").select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("region"))
    return catalog.regions(n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 == 0, "Own").alias("region")), fixed)


@query("""SELECT c_custkey AS k, c_mktsegment AS seg FROM customer WHERE c_custkey % 6 = 0 OR (c_custkey % 4 = 0 AND c_mktsegment IS NOT NULL)""")
def reconciled_rows(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"))
    old = c.withColumn("seg", F.when(F.col("k") % 6 == 0, "before").when(F.col("k") % 4 != 0, F.col("seg")))
    return catalog.changed(old, c, "k", ["seg"])


@query("""SELECT c.c_custkey AS id FROM customer c WHERE c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)""")
def live_desks(spark, sf_dir):
    desks = read(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("id"))
    return catalog.of_live_desks(read(spark, sf_dir, "customer"), desks, "c_nationkey").select(F.col("c_custkey").alias("id"))


@query(r"""SELECT lang AS country, count(DISTINCT d) AS publishers, count(DISTINCT d) >= 5 AS enough FROM (
  SELECT regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, regexp_extract(regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', ''), '([^.]+\.(?:(?:co|com|org|gov|net|ac)\.)?[^.]+)$', 1) AS d FROM pages) GROUP BY 1""")
def publisher_floor(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "/(en|fr|de|es)/", 1).alias("country"), text.domain("url").alias("domain"))
    return catalog.independent_publishers(p, 5)


@query("""WITH k AS (SELECT event_id, regexp_replace(lower(event_type || (event_id % 50)), '[^a-z0-9]+', '', 'g') AS key FROM events) SELECT min(event_id) AS event_id FROM k GROUP BY key""")
def distinct_event_titles(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("title"))
    return feeds.distinct_titles(e, [F.asc("event_id")]).select("event_id")


@query(f"""WITH f AS (SELECT event_id, CAST(event_id % 100 AS VARCHAR) AS url, ts FROM events WHERE event_id % 2 = 0), p AS (SELECT event_id, CAST(event_id % 150 AS VARCHAR) AS url, ts FROM events WHERE event_id % 2 = 1)
SELECT event_id FROM f UNION ALL SELECT event_id FROM p WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND url NOT IN (SELECT url FROM f)""")
def event_carry_over(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("ts", "at")
    f = e.where("event_id % 2 = 0").select("event_id", (F.col("event_id") % 100).cast("string").alias("url"), "at")
    p = e.where("event_id % 2 = 1").select("event_id", (F.col("event_id") % 150).cast("string").alias("url"), "at")
    return feeds.carried_over(f, p, now() - F.make_dt_interval(F.lit(7))).select("event_id")


@query(f"""WITH {ARTICLE}, k AS (SELECT id, country, 'gn:' || regexp_replace(lower(source_id), '[^\\p{{L}}\\p{{N}}]+', '-', 'g') AS source_id, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key FROM article)
SELECT id, source_id FROM k WHERE key <> '' AND id % 2 = 1 AND (country, key) NOT IN (SELECT (country, key) FROM k WHERE id % 2 = 0)""")
def aggregator_scan(spark, sf_dir):
    a = articles(spark, sf_dir)
    items = a.where("id % 2 = 1").select("id", "country", F.concat("title", F.lit(" - "), "source_id").alias("title"), F.col("source_id").alias("outlet"))
    known = a.where("id % 2 = 0").select("country", text.title_key("title").alias("key"))
    return feeds.aggregator_items(items, known).select("id", "source_id")


@query()
def item_summaries(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.select("id", feeds.summary(F.lit("news"), F.col("text")).alias("summary"))


@query()
def watch_feed(spark, sf_dir):
    a = articles(spark, sf_dir).where(F.lower("title").rlike(patterns.any_term(["the", "und"]))).orderBy(F.desc("at"), F.desc("id")).limit(100)
    return sources.rss_items(a)


@query(f"""WITH {ARTICLE} SELECT story_id, list_sort(list_distinct(list(country))) AS countries, count(*) AS n FROM article WHERE category IN ('economics', 'society') GROUP BY 1""")
def event_tabs(spark, sf_dir):
    a = articles(spark, sf_dir).where(F.col("category").isin("economics", "society"))
    return a.groupBy("story_id").agg(F.sort_array(F.collect_set("country")).alias("countries"), F.count("*").alias("n"))


@query(f"""WITH {COVERAGE} SELECT story_id, CASE WHEN last_24h = articles THEN 'New' WHEN last_24h / articles >= 0.4 THEN 'Growing' WHEN last_24h = 0 THEN 'Quiet' ELSE '' END AS trend FROM scored""")
def trend_badges(spark, sf_dir):
    return scored(spark, sf_dir).select("story_id", text.trend("last_24h", "articles").alias("trend"))


#: The home page's lists: rows, what leads, places in all, of a region, of a country.
HOME = {
    "most": ("true", "breadth", 8, 3, 2), "growing": ("state = 'surging'", "velocity", 6, 3, 2), "elections": ("id % 7 = 0", "breadth", 6, 3, 1),
    "disasters": ("id % 11 = 0", "breadth", 12, 5, 2), "violence": ("id % 13 = 0 AND id % 11 <> 0", "breadth", 12, 5, 2),
}


def _home_sql(name: str) -> str:
    rows, by, places, region, country = HOME[name]
    order = f"{by} DESC, score DESC, id"
    return f"""{name}_i AS (SELECT * FROM story WHERE {rows}),
{name}_a AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {order}) AS c FROM {name}_i),
{name}_f AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM {name}_a WHERE c <= (SELECT CASE WHEN count(DISTINCT country) >= {places} THEN 1 ELSE {country} END FROM {name}_i)),
{name}_g AS (SELECT * FROM {name}_f WHERE place <= {places}), {name}_t AS (SELECT country, count(*) AS n FROM {name}_g GROUP BY 1),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY {order}) AS c FROM {name}_i WHERE id NOT IN (SELECT id FROM {name}_g)),
{name}_s AS (SELECT r.*, row_number() OVER (PARTITION BY region ORDER BY {order}) AS rr FROM {name}_r r LEFT JOIN {name}_t t USING (country) WHERE r.c <= {country} - coalesce(t.n, 0)),
{name} AS (SELECT '{name}' AS list, id, place FROM {name}_g UNION ALL SELECT '{name}', id, {places} + row_number() OVER (ORDER BY {order}) FROM {name}_s WHERE rr <= {region})"""


@query(f"""WITH base AS (
  SELECT c_custkey AS id, n_name AS country, r_name AS region, c_acctbal AS score, c_custkey % 50 + 1 AS n, c_custkey % 9 AS h, c_custkey % 60 + 1 AS k,
    c_custkey % 4 AS dom, c_custkey % 3 AS abroad, c_custkey % 2 AS intl, CASE WHEN c_custkey % 5 = 0 THEN 'surging' ELSE 'steady' END AS state
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
day AS (SELECT *, least(CAST(n AS DOUBLE), CAST(h * n AS DOUBLE) / greatest(1, k)) AS d FROM base),
story AS (SELECT *, least(n, 15.0::DOUBLE) / 15.0::DOUBLE + 0.12::DOUBLE * log2(1 + greatest(0.0::DOUBLE, n - 15.0::DOUBLE)) + CASE WHEN dom >= 2 THEN 0.12::DOUBLE ELSE 0 END
    + CASE WHEN (dom > 0)::INT + (abroad > 0)::INT + (intl > 0)::INT >= 2 THEN 0.08::DOUBLE ELSE 0 END AS breadth,
    least(d, 15.0::DOUBLE) / 15.0::DOUBLE + 0.12::DOUBLE * log2(1 + greatest(0.0::DOUBLE, d - 15.0::DOUBLE)) AS velocity FROM day),
{", ".join(map(_home_sql, HOME))}
{" UNION ALL ".join(f"SELECT * FROM {name}" for name in HOME)}""")
def home_lists(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    i = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))
    k = F.col("c_custkey")
    s = i.select(k.alias("id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("score"), (k % 50 + 1).alias("independent"), (k % 9).alias("last_24h"), (k % 60 + 1).alias("articles"))
    s = s.withColumns({"domestic": F.col("id") % 4, "abroad_local": F.col("id") % 3, "international": F.col("id") % 2})
    s = s.withColumn("state", F.when(F.col("id") % 5 == 0, "surging").otherwise("steady")).withColumn("themes", F.when(F.col("id") % 7 == 0, F.array(F.lit("Elections"))).otherwise(F.array(F.lit("Trade"))))
    s = s.withColumn("title", F.when(F.col("id") % 11 == 0, "Flood in the valley").when(F.col("id") % 13 == 0, "Riot downtown").otherwise("Report"))
    lists = views.home(stories.breadth(s, F.lit(15.0)))
    out = None
    for name, df in lists.items():
        part = df.select(F.lit(name).alias("list"), "id", F.col("place").cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out
