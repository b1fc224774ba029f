"""The named queries of the news operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import sources, streaming
from ..functions import patterns, text, vectors
from ..operators import clustering, delta, events, excerpts, graph, ranking, relevance, stories, syndication
from .fixtures import ARTICLE, FACTS_SQL, NOW, articles, pick, read, story_facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Aggregations and reports


@query(f"""WITH {ARTICLE} SELECT scope, count(*) AS n, count(*) FILTER (lead <> '') AS with_lead FROM article GROUP BY 1""")
def scope_report(spark, sf_dir):
    return articles(spark, sf_dir).groupBy("scope").agg(F.count("*").alias("n"), F.count_if(F.col("lead") != "").alias("with_lead"))


COVERAGE = f"""{ARTICLE}, {FACTS_SQL}, cov AS (
  SELECT story_id, count(*) AS articles, greatest(1, count(DISTINCT CASE WHEN syndicated_of IS NULL THEN source_id END)) AS independent,
    count(DISTINCT scope) AS scopes, count(*) FILTER (tm >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS last_24h,
    count(*) FILTER (scope = 'domestic') AS domestic, count(*) FILTER (scope = 'abroad_local') AS abroad_local, count(*) FILTER (scope = 'international') AS international
  FROM article WHERE similarity >= 0.93 GROUP BY 1),
scored AS (
  SELECT *, round(b * (0.6 + 0.5 * policy) + 1.2 * policy + CASE WHEN lower(themes[1]) LIKE '%election%' THEN 2.5 ELSE 0 END, 2) AS score FROM (
    SELECT c.*, s.policy, s.themes, c.independent + CASE WHEN independent >= 5 THEN 2 + 0.5 * (independent - 5) WHEN independent >= 3 THEN 1 ELSE 0 END
      + 0.5 * (scopes - 1) + CASE WHEN last_24h / articles >= 0.4 THEN 1 ELSE 0 END + 0.2 * log2(articles) AS b
    FROM cov c JOIN story s USING (story_id)))"""


def scored(spark, sf_dir):
    return stories.scores(stories.coverage(articles(spark, sf_dir), NOW).join(story_facts(spark), "story_id"))


@query(f"WITH {COVERAGE} SELECT story_id, articles, independent, scopes, last_24h, score FROM scored")
def story_rank(spark, sf_dir):
    return scored(spark, sf_dir).select("story_id", "articles", "independent", "scopes", "last_24h", "score")


@query(f"""WITH {COVERAGE}, x AS (SELECT *, 15.0 AS s, least(CAST(independent AS DOUBLE), CAST(last_24h * independent AS DOUBLE) / greatest(1, articles)) AS day FROM scored)
SELECT story_id, round(least(independent, s) / s + 0.12 * log2(1 + greatest(0, independent - s)) + CASE WHEN domestic >= 2 THEN 0.12 ELSE 0 END
  + CASE WHEN (domestic > 0)::INT + (abroad_local > 0)::INT + (international > 0)::INT >= 2 THEN 0.08 ELSE 0 END, 6) AS breadth,
  round(least(day, s) / s + 0.12 * log2(1 + greatest(0, day - s)), 6) AS velocity FROM x""")
def breadth_velocity(spark, sf_dir):
    b = stories.breadth(scored(spark, sf_dir), F.lit(15.0))
    return b.select("story_id", F.round("breadth", 6).alias("breadth"), F.round("velocity", 6).alias("velocity"))


@query(f"""WITH {ARTICLE}, c AS (SELECT * FROM article WHERE similarity >= 0.93)
SELECT story_id, round(count(*) FILTER (state_outlet OR kind = 'official') / count(*), 2) AS state_share, bool_or(kind = 'official') AS official,
  count(*) FILTER (factuality = 'high') AS high, count(*) FILTER (factuality = 'mixed') AS mixed FROM c GROUP BY 1""")
def state_share(spark, sf_dir):
    c = articles(spark, sf_dir).where("similarity >= 0.93")
    return c.groupBy("story_id").agg(
        F.round(F.count_if(F.col("state_outlet") | (F.col("kind") == "official")) / F.count("*"), 2).alias("state_share"),
        F.bool_or(F.col("kind") == "official").alias("official"), F.count_if(F.col("factuality") == "high").alias("high"), F.count_if(F.col("factuality") == "mixed").alias("mixed"),
    )


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS volume FROM events GROUP BY 1, 2")
def daily_histogram(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("volume"))


@query(f"""WITH {ARTICLE} SELECT story_id, strftime(min(tm), '%Y-%m-%d %H') AS first_seen, strftime(max(tm), '%Y-%m-%d %H') AS last_seen,
  arg_min(source_id, (tm, id)) AS first_source FROM article GROUP BY 1""")
def first_and_last_seen(spark, sf_dir):
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH")
    a = articles(spark, sf_dir)
    return a.groupBy("story_id").agg(day(F.min("at")).alias("first_seen"), day(F.max("at")).alias("last_seen"), F.min_by("source_id", F.struct("at", "id")).alias("first_source"))


@query(f"""WITH {ARTICLE} SELECT story_id, CASE WHEN max(n) * 2 >= sum(n) THEN arg_max(category, (n, category)) ELSE 'other' END AS category
FROM (SELECT story_id, category, count(*) AS n FROM article GROUP BY ALL) GROUP BY 1""")
def majority_category(spark, sf_dir):
    n = articles(spark, sf_dir).groupBy("story_id", "category").agg(F.count("*").alias("n"))
    top = F.max_by("category", F.struct("n", "category"))
    return n.groupBy("story_id").agg(F.when(F.max("n") * 2 >= F.sum("n"), top).otherwise("other").alias("category"))


@query(f"""WITH {ARTICLE}, c(country) AS (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')), h AS (
  SELECT country, count(*) AS n, max(tm) AS last FROM article GROUP BY 1)
SELECT c.country, coalesce(h.n, 0) AS n, CASE WHEN coalesce(h.n, 0) > 0 THEN 'healthy' ELSE 'standby' END AS status FROM c LEFT JOIN h USING (country)""")
def desk_telemetry(spark, sf_dir):
    c = spark.createDataFrame([(x,) for x in ("en", "fr", "de", "es", "xx")], "country string")
    h = articles(spark, sf_dir).groupBy("country").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return c.join(h, "country", "left").select("country", n.alias("n"), F.when(n > 0, "healthy").otherwise("standby").alias("status"))


@query("""SELECT n.n_name AS nation, count(*) AS direct, count(DISTINCT s.s_name) AS names, count(*) >= 3 AS compliant
FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY 1""")
def registry_guards(spark, sf_dir):
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    j = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))  # nations are a fixed, small catalog
    return j.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("direct"), F.count_distinct("s_name").alias("names"), (F.count("*") >= 3).alias("compliant"))


@query(f"""WITH {ARTICLE} SELECT country, count(*) FILTER (strftime(tm, '%d') >= '24') AS recent, count(DISTINCT story_id) AS stories,
  count(*) FILTER (category = 'economics') AS economics, count(*) FILTER (category = 'society') AS society FROM article GROUP BY 1""")
def desk_rollup(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.groupBy("country").agg(
        F.count_if(F.date_format("at", "dd") >= "24").alias("recent"), F.count_distinct("story_id").alias("stories"),
        F.count_if(F.col("category") == "economics").alias("economics"), F.count_if(F.col("category") == "society").alias("society"),
    )


# Windows of time


@query(f"""WITH {ARTICLE}, p AS (SELECT *, CASE WHEN tm >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'curr' WHEN tm >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY THEN 'prev' END AS p FROM article),
g AS (SELECT story_id, count(*) FILTER (p = 'curr') AS curr, count(*) FILTER (p = 'prev') AS prev,
    count(*) FILTER (p = 'prev' AND scope = 'domestic') AS pd, count(*) FILTER (p = 'curr' AND scope = 'international') AS ci, count(*) FILTER (p = 'curr' AND scope = 'abroad_local') AS ca,
    count(*) FILTER (p = 'curr' AND similarity >= 0.93) AS cc, count(*) FILTER (p = 'prev' AND similarity >= 0.93) AS cp,
    count(*) FILTER (p = 'curr' AND similarity >= 0.93 AND state_outlet) AS sc, count(*) FILTER (p = 'prev' AND similarity >= 0.93 AND state_outlet) AS sp
  FROM p WHERE p IS NOT NULL GROUP BY 1),
h AS (SELECT *, curr - prev AS net, round(curr / greatest(1, prev), 2) AS ratio, round(coalesce(sc / nullif(cc, 0), 0), 2) AS s1, round(coalesce(sp / nullif(cp, 0), 0), 2) AS s0 FROM g)
SELECT story_id, curr, prev, net, ratio,
  CASE WHEN prev = 0 AND curr >= 2 THEN 'new' WHEN net >= 3 AND ratio >= 1.75 THEN 'surging' WHEN net <= -3 AND ratio <= 0.4 THEN 'cooling' WHEN curr >= 2 THEN 'steady' ELSE 'trace' END AS state,
  round(net / sqrt(greatest(1, prev)), 2) AS velocity_z,
  CASE WHEN prev > 0 AND pd = prev AND ci > 0 THEN 'international_pickup' WHEN prev > 0 AND pd = prev AND ca > 0 THEN 'diaspora_pickup' END AS scope_shift,
  s1 AS state_share_curr, s0 AS state_share_prev, cc >= 4 AND cp >= 4 AND round(s1 - s0, 2) >= 0.3 AS state_surge, cc >= 4 AND cp >= 4 AND round(s1 - s0, 2) <= -0.3 AS state_recede FROM h""")
def story_delta_states(spark, sf_dir):
    return delta.story_deltas(articles(spark, sf_dir), NOW, 7)


AGENDA = ["click", "view", "purchase", "signup", "error", "other"]


@query(f"""WITH c(category) AS (VALUES {", ".join(f"('{x}')" for x in AGENDA)}), s AS (
  SELECT event_type AS category, count(*) FILTER (ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS curr,
    count(*) FILTER (ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS prev FROM events GROUP BY 1),
j AS (SELECT category, coalesce(curr, 0) AS curr, coalesce(prev, 0) AS prev FROM c LEFT JOIN s USING (category)),
t AS (SELECT greatest(1, CAST(sum(curr) AS BIGINT)) AS tc, greatest(1, CAST(sum(prev) AS BIGINT)) AS tp FROM j)
SELECT category, curr, prev, curr - prev AS net, round(100.0 * curr / tc, 1) AS share_pct, round(100.0 * curr / tc - 100.0 * prev / tp, 1) AS share_delta_pct FROM j, t""")
def agenda_delta(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("ts").alias("at"))
    return delta.agenda(e, NOW, 7, AGENDA)


@query(f"SELECT count(*) AS kept, CAST(sum(user_id) AS BIGINT) AS users FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 20 DAY")
def retention_prune(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.col("ts") >= F.expr(f"timestamp '{NOW}' - interval 20 days"))
    return e.agg(F.count("*").alias("kept"), F.sum("user_id").alias("users"))


@query(f"""SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn
  FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) WHERE rn <= 10""")
def feed_newest_n(spark, sf_dir):
    e = read(spark, sf_dir, "events").where(F.coalesce(F.col("ts"), F.lit(NOW).cast("timestamp")) >= F.expr(f"timestamp '{NOW}' - interval 7 days"))
    return ranking.top_per(e, ["user_id"], [F.desc("ts"), F.asc("event_id")], 10).select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


@query("""SELECT event_id, user_id % 6 AS errors, CASE WHEN user_id % 6 >= 3 THEN CAST(least(48, 6 * pow(2, user_id % 6 - 3)) AS BIGINT) END AS wait_hours FROM events""")
def feed_backoff(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("errors", F.col("user_id") % 6)
    wait = F.unix_timestamp(streaming.backoff(F.col("errors"), F.col("ts"))) - F.unix_timestamp("ts")
    return e.select("event_id", "errors", (wait / 3600).cast("long").alias("wait_hours"))


# Text, addresses and titles


@query(r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages)
SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))
  || regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g')
  || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS clean_url,
  regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '') AS domain,
  lower(regexp_extract(url, 'https?://[^/]+/([^/?#]+)', 1)) AS section
FROM (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains(
  ['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'msclkid', 'mc_eid', '_ga', '_gl', 'ref', 'ref_src',
   'vn_source', 'vn_campaign', 'vn_medium', 'session_id', 'at_custom1', 'at_custom2'], lower(split_part(x, '=', 1)))) AS k FROM p)""")
def url_canonical(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", text.clean_url("url").alias("clean_url"), text.domain("url").alias("domain"), text.url_section("url").alias("section"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)), '^www\.', '') AS domain FROM pages)
SELECT domain, count(*) AS n, min(page_id) AS first FROM p GROUP BY 1""")
def pages_by_domain(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(text.domain("url").alias("domain")).agg(F.count("*").alias("n"), F.min("page_id").alias("first"))


@query(f"""WITH {ARTICLE}, k AS (SELECT *, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS key FROM article),
f AS (SELECT *, first_value(id) OVER w AS fid, first_value(source_id) OVER w AS fs FROM k WHERE key <> '' WINDOW w AS (PARTITION BY country, key ORDER BY tm, id))
SELECT id, fid AS syndicated_of FROM f WHERE fid <> id AND fs <> source_id""")
def title_key_dedupe(spark, sf_dir):
    return syndication.same_titles(articles(spark, sf_dir).withColumn("ord", F.col("at")))


@query(f"""WITH {ARTICLE} SELECT sha256(CASE WHEN text <> '' THEN text ELSE title || ' ' || coalesce(lead, '') END) AS content_hash, count(*) AS n, min(id) AS first
FROM article GROUP BY 1 HAVING count(*) > 1""")
def content_hash_dups(spark, sf_dir):
    h = articles(spark, sf_dir).groupBy(text.content_hash("text", "title", "lead").alias("content_hash")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return h.where("n > 1")


@query(f"""WITH {ARTICLE}, w AS (SELECT id, country, source_id, kind, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM article),
s AS (SELECT id, country, source_id, kind, list_distinct(list_filter(list_transform(range(1, len(w) - 6), lambda i: substr(md5(array_to_string(w[i:i + 7], ' ')), 1, 16)),
  lambda h: substr(h, 16, 1) IN ('0', '4', '8', 'c'))) AS hs FROM w WHERE len(w) >= 8),
f AS (SELECT id, country, source_id, unnest(hs) AS h FROM s WHERE len(hs) >= 5),
v AS (SELECT b.id, a.id AS of, count(*) AS votes FROM f b JOIN f a ON a.country = b.country AND a.h = b.h AND a.id < b.id AND a.source_id <> b.source_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, of) AS rn FROM v)
SELECT r.id, r.of AS syndicated_of, r.votes, CAST(len(s.hs) AS BIGINT) AS n_hashes FROM r JOIN s ON s.id = r.id JOIN s a ON a.id = r.of
WHERE rn = 1 AND r.votes / len(s.hs) >= CASE WHEN a.kind = 'wire' THEN 0.35 ELSE 0.6 END""")
def shingle_syndication(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", "country", "source_id", F.col("id").alias("ord"), text.content("text", "title", "lead").alias("content"), (F.col("kind") == "wire").alias("wire"))
    return syndication.reprints(a)


@query(f"""WITH {ARTICLE} SELECT id FROM article WHERE regexp_matches(lower(strip_accents(title || ' ' || coalesce(lead, ''))), 'reponse|etre|haupt|the ')""")
def search_fold(spark, sf_dir):
    a = articles(spark, sf_dir)
    return a.where(text.fold(F.concat_ws(" ", "title", "lead")).rlike("reponse|etre|haupt|the ")).select("id")


@query(r"""SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]{4,}'),
  lambda w: NOT list_contains(['attack', 'attacks', 'strike', 'strikes', 'clash', 'clashes', 'killed', 'kills', 'kill', 'killing', 'dead', 'death', 'over', 'after', 'with', 'from', 'into',
  'amid', 'says', 'said', 'report', 'reports', 'news', 'more', 'than', 'least', 'three', 'four', 'five', 'against', 'under', 'near'], w)),
  lambda w: regexp_replace(w, 's+$', '')), lambda w: length(w) >= 3))) AS tokens FROM documents""")
def headline_tokens(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_sort(text.significant_tokens(F.split_part("text", F.lit("\n"), F.lit(1)))).alias("tokens"))


@query("""SELECT doc_id, CASE WHEN n <= 120 THEN t ELSE regexp_replace(regexp_replace(substr(t, 1, 120), '\\s\\S*$', ''), '[ ,.;:]+$', '') || '…' END AS lead
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t, length(split_part(text, chr(10), 1)) AS n FROM documents)""")
def clipped_leads(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clip(F.split_part("text", F.lit("\n"), F.lit(1)), 120).alias("lead"))


@query("""WITH t AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 90) || 'K+' WHEN event_id % 3 = 1 THEN (event_id % 7) || '.5M' ELSE CAST(event_id % 900 AS VARCHAR) END AS s FROM events),
n AS (SELECT *, CAST(CAST(regexp_extract(s, '([0-9.]+)') AS DOUBLE) * CASE WHEN s LIKE '%K%' THEN 1000 WHEN s LIKE '%M%' THEN 1000000 ELSE 1 END AS BIGINT) AS traffic FROM t)
SELECT user_id, event_id, traffic FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY traffic DESC, event_id) AS rn FROM n) WHERE rn <= 8""")
def trends_topk(spark, sf_dir):
    i = F.col("event_id")
    s = F.when(i % 3 == 0, F.concat((i % 90).cast("string"), F.lit("K+"))).when(i % 3 == 1, F.concat((i % 7).cast("string"), F.lit(".5M"))).otherwise((i % 900).cast("string"))
    e = read(spark, sf_dir, "events").withColumn("traffic", text.traffic(s))
    return ranking.top_per(e, ["user_id"], [F.desc("traffic"), F.asc("event_id")], 8).select("user_id", "event_id", "traffic")


@query()
def clean_titles(spark, sf_dir):
    m = sources.page_meta(read(spark, sf_dir, "pages"))
    return m.select("page_id", text.clean("meta_title").alias("title"), F.length(text.clean("meta_title")).alias("n"))


@query()
def html_main_text(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("body", text.nfc(sources.main_text("html")))
    return p.select("page_id", F.length("body").alias("n_chars"), sources.extract_status(F.lit(200), F.lit(True), F.col("body")).alias("status"))


# Relevance, scope and matching


@query(f"""WITH {ARTICLE}, r AS (SELECT *, CASE
    WHEN regexp_matches(lower(title), 'live stream|premier league') THEN false WHEN country = 'es' THEN false
    WHEN scope = 'domestic' AND country <> 'fr' THEN true WHEN regexp_matches(lower(title || ' ' || lead), '\\bder\\b|\\bthe\\b') THEN true
    ELSE len(regexp_extract_all(lower(text), '\\bder\\b|\\bthe\\b')) >= 2 END AS relevant FROM article)
SELECT country, scope, count(*) FILTER (relevant) AS kept, count(*) AS n FROM r GROUP BY 1, 2""")
def relevance_by_desk(spark, sf_dir):
    none, no = F.lit(None).cast("string"), F.lit(False)
    lists = lambda *x: F.array(*map(F.lit, x))
    c = [F.col(x) for x in ("url", "title", "lead", "text")]
    keep = relevance.is_relevant(F.col("scope"), none, none, *c, no, no, lists("fr", "world"), lists("es", "sport"), F.lit(patterns.any_term(["der", "the"])), none)
    return articles(spark, sf_dir).withColumn("k", keep).groupBy("country", "scope").agg(F.count_if("k").alias("kept"), F.count("*").alias("n"))


@query(f"""WITH {ARTICLE}, w(word) AS (VALUES ('the'), ('und'), ('les'), ('idiot'))
SELECT a.id, list_sort(list(w.word)) AS hits FROM article a JOIN w ON regexp_matches(lower(a.title || ' ' || a.lead), '(^|[^\\p{{L}}\\p{{N}}_])' || w.word || '($|[^\\p{{L}}\\p{{N}}_])') GROUP BY 1""")
def watchlist_match(spark, sf_dir):
    w = spark.createDataFrame([(x, patterns.any_term([x])) for x in ("the", "und", "les", "idiot")], "word string, re string")  # a reader's own short list
    a = articles(spark, sf_dir).select("id", F.concat_ws(" ", "title", "lead").alias("t"))
    return a.join(F.broadcast(w), F.regexp_like("t", F.col("re"))).groupBy("id").agg(F.sort_array(F.collect_list("word")).alias("hits"))


@query(f"""WITH {ARTICLE}, o(ord, name, scope) AS (VALUES (1, 'src1', 'domestic'), (2, 'src12', 'abroad_local'), (3, 'rc15', 'international')),
x AS (SELECT a.id, a.source_id, a.scope, arg_min(o.scope, o.ord) FILTER (o.name = a.source_id) AS e,
    arg_min(o.scope, o.ord) FILTER (length(o.name) >= 4 AND contains(a.source_id, o.name)) AS i FROM article a LEFT JOIN o ON true GROUP BY ALL)
SELECT id, coalesce(e, i, CASE WHEN id % 2 = 0 THEN scope END, 'international') AS resolved_scope FROM x""")
def scope_resolution(spark, sf_dir):
    o = [(c, k, n, s) for c in ("en", "fr", "de", "es") for k, n, s in ((1, "src1", "domestic"), (2, "src12", "abroad_local"), (3, "rc15", "international"))]
    a = articles(spark, sf_dir).select("id", "country", F.concat(F.lit("gn:"), "source_id").alias("source_id"), F.col("source_id").alias("source_name"), "scope", F.when(F.col("id") % 2 == 0, F.col("scope")).alias("feed_scope"))
    return relevance.resolve_scope(a, spark.createDataFrame(o, "country string, ord int, name string, scope string")).select("id", "resolved_scope")


@query(f"""WITH {ARTICLE} SELECT story_id, round(avg(CASE WHEN regexp_matches(lower(title), '(^|[^\\p{{L}}\\p{{N}}_])(thing|the)($|[^\\p{{L}}\\p{{N}}_])|(^|[^\\p{{L}}\\p{{N}}_])(eauaneux)') THEN 1.0
  WHEN regexp_matches(lower(lead), '(^|[^\\p{{L}}\\p{{N}}_])(thing|the)($|[^\\p{{L}}\\p{{N}}_])|(^|[^\\p{{L}}\\p{{N}}_])(eauaneux)') THEN 0.3 ELSE 0 END), 6) AS share FROM article GROUP BY 1""")
def keyword_share(spark, sf_dir):
    s = stories.keyword_share(articles(spark, sf_dir), ["thing", "the", "eauaneux"])
    return s.select("story_id", F.round("share", 6).alias("share"))


LABELS = [("Storm", "the an"), ("Flood", "der die"), ("Quake", "le la")]


@query(f"""WITH {ARTICLE} SELECT id, CASE WHEN regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}_])(the|an)($|[^\\p{{L}}\\p{{N}}_])') THEN 'Storm'
  WHEN regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}_])(der|die)($|[^\\p{{L}}\\p{{N}}_])') THEN 'Flood' WHEN regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}_])(le|la)($|[^\\p{{L}}\\p{{N}}_])') THEN 'Quake' END AS label
FROM (SELECT id, lower(title) AS b FROM article)""")
def ordered_labels(spark, sf_dir):
    return articles(spark, sf_dir).select("id", patterns.first_label(F.col("title"), patterns.word_rules(LABELS)).alias("label"))


# Joins, sets and upserts


@query("""SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY split_part(url, '?', 1) ORDER BY page_id) AS rn FROM pages
  WHERE page_id % 3 <> 0 AND split_part(url, '?', 1) NOT IN (SELECT split_part(url, '?', 1) FROM pages WHERE page_id % 3 = 0)) WHERE rn = 1""")
def insert_ignore(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.split_part("url", F.lit("?"), F.lit(1)).alias("key"))
    return ranking.insert_ignore(p.where("page_id % 3 <> 0"), p.where("page_id % 3 = 0"), "key", [F.asc("page_id")]).select("page_id", "url")


@query("""SELECT coalesce(n.k, o.k) AS k, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal
FROM (SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 2 = 0) o FULL JOIN
  (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS name, CASE WHEN c_custkey % 7 <> 0 THEN -c_acctbal END AS bal FROM customer WHERE c_custkey % 3 = 0) n ON n.k = o.k""")
def upsert_coalesce(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 2 == 0).select(k.alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where(k % 3 == 0).select(k.alias("k"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("name"), F.when(k % 7 != 0, -F.col("c_acctbal")).alias("bal"))
    return ranking.upsert(old, new, "k")


@query(f"""WITH {ARTICLE} SELECT id FROM article WHERE id NOT IN (SELECT vec_id FROM embeddings) AND tm >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY""")
def embed_candidates(spark, sf_dir):
    a = articles(spark, sf_dir).where(F.col("at") >= F.expr(f"timestamp '{NOW}' - interval 14 days"))
    return a.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti").select("id")


@query(f"""WITH {ARTICLE} SELECT story_id FROM article WHERE country IN ('en', 'fr') GROUP BY 1 HAVING count(DISTINCT country) = 2""")
def relations_division(spark, sf_dir):
    chosen = ["en", "fr"]
    a = articles(spark, sf_dir).where(F.col("country").isin(chosen)).groupBy("story_id").agg(F.count_distinct("country").alias("n"))
    return a.where(F.col("n") == len(chosen)).select("story_id")


@query("""WITH p AS (SELECT o_orderkey AS id, 0 AS part FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_totalprice > 200000)
SELECT id, min(part) AS part FROM p GROUP BY 1""")
def ordered_union(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return ranking.union_distinct([o.where("o_orderpriority = '1-URGENT'").select("id"), o.where("o_totalprice > 200000").select("id")], "id")


@query("""SELECT n.n_name AS nation, r.r_name AS region, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total, max(o.o_totalprice) AS largest
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2""")
def star_join(spark, sf_dir):
    o, c, n, r = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    dims = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    j = o.select("o_custkey", "o_totalprice").join(dims.select("c_custkey", "n_name", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_totalprice").alias("largest"))


# Top-k and quotas


@query("""SELECT p_brand AS brand, p_partkey AS id, rn FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) WHERE rn <= 3""")
def top_per_category(spark, sf_dir):
    t = ranking.top_per(read(spark, sf_dir, "part"), ["p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 3)
    return t.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("rn").cast("long").alias("rn"))


@query("""WITH i AS (SELECT c_custkey AS id, n_name AS country, r_name AS region, c_acctbal AS v FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY v DESC, id) AS c FROM i),
f AS (SELECT *, row_number() OVER (ORDER BY v DESC, id) AS place FROM a WHERE c <= (SELECT CASE WHEN count(DISTINCT country) >= 8 THEN 1 ELSE 2 END FROM i)),
g AS (SELECT id, country, region, place FROM f WHERE place <= 8), t AS (SELECT country, count(*) AS n FROM g GROUP BY 1),
r AS (SELECT i.*, row_number() OVER (PARTITION BY i.country ORDER BY v DESC, id) AS c FROM i WHERE id NOT IN (SELECT id FROM g)),
s AS (SELECT r.*, row_number() OVER (PARTITION BY region ORDER BY v DESC, id) AS rr FROM r LEFT JOIN t USING (country) WHERE c <= 2 - coalesce(t.n, 0))
SELECT * FROM g UNION ALL SELECT id, country, region, 8 + row_number() OVER (ORDER BY v DESC, id) FROM s WHERE rr <= 3""")
def quota_global_regional(spark, sf_dir):
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    i = c.join(F.broadcast(n), F.col("n_nationkey") == F.col("c_nationkey")).join(F.broadcast(r), F.col("r_regionkey") == F.col("n_regionkey"))
    i = i.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_acctbal").alias("v"))
    return ranking.global_and_regional(i, [F.desc("v"), F.asc("id")], 8, 3, 2).select("id", "country", "region", F.col("place").cast("long").alias("place"))


@query(f"""WITH {ARTICLE}, p AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY similarity DESC, id DESC) AS k FROM article),
q AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY similarity DESC, id DESC) AS rn FROM p WHERE k <= 3)
SELECT id, country, row_number() OVER (ORDER BY rn, similarity DESC, id DESC) AS turn FROM q""")
def pending_round_robin(spark, sf_dir):
    order = [F.desc("similarity"), F.desc("id")]
    p = ranking.top_per(articles(spark, sf_dir), ["story_id"], order, 3, "k")
    return ranking.round_robin(p, "country", order).select("id", "country", F.col("turn").cast("long").alias("turn"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_custkey % 10 AS country, o_totalprice AS score, o_orderkey % 9 AS independent, o_orderkey % 4 AS last_24h, o_orderpriority = '1-URGENT' AS e FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY country, e ORDER BY independent DESC, score DESC, last_24h DESC, id) AS rn FROM s),
n AS (SELECT country, count(*) AS n_elections, list(id ORDER BY rn) FILTER (rn > 1 AND rn <= 6) AS nested FROM r WHERE e GROUP BY 1)
SELECT r.id, r.country, CASE WHEN e THEN n.n_elections END AS n_elections, CASE WHEN e THEN n.nested END AS nested FROM r LEFT JOIN n USING (country) WHERE NOT e OR rn = 1""")
def election_collapse(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    themes = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("Elections"))).otherwise(F.array(F.lit("Trade")))
    i = F.col("o_orderkey")
    s = o.select(i.alias("id"), (F.col("o_custkey") % 10).alias("country"), F.col("o_totalprice").alias("score"), (i % 9).alias("independent"), (i % 4).alias("last_24h"), themes.alias("themes"))
    return stories.collapse_elections(s).select("id", "country", "n_elections", "nested")


# Vectors and clusters


@query("""WITH x AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
m AS (SELECT label, p, avg(CAST(v AS DOUBLE)) AS m FROM x GROUP BY 1, 2)
SELECT label, round(sum(m * m), 9) AS square, round(sum(CASE WHEN p = 1 THEN m END), 9) AS first FROM m GROUP BY 1""")
def centroid_by_label(spark, sf_dir):
    c = vectors.mean_vectors(read(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return c.select("label", F.round(vectors.dot("centroid", "centroid"), 9).alias("square"), F.round(F.element_at("centroid", 1), 9).alias("first"))


VECTOR = """v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(vec_id % 240 AS INTEGER)) AS tm FROM embeddings)"""


def timed_vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("country"), F.col("label"), F.expr("timestamp '2024-01-01' + make_dt_interval(0, cast(vec_id % 240 as int))").alias("at"), F.col("embedding").cast("array<double>").alias("vector"))


@query(f"""WITH {VECTOR} SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS sim FROM v a JOIN v b ON a.id < b.id AND a.label % 3 = b.label % 3
WHERE abs(epoch(a.tm) - epoch(b.tm)) <= 259200 AND list_cosine_similarity(a.v, b.v) >= 0.33""")
def pair_similarity_band(spark, sf_dir):
    return clustering.near_pairs(timed_vectors(spark, sf_dir), 0.33, 3).withColumn("sim", F.round("sim", 6))


@query(f"""WITH RECURSIVE {VECTOR}, e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id AND a.label % 3 = b.label % 3
WHERE abs(epoch(a.tm) - epoch(b.tm)) <= 259200 AND list_cosine_similarity(a.v, b.v) >= 0.33),
r AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT node, min(c) AS component FROM r GROUP BY 1""")
def near_components(spark, sf_dir):
    return graph.components(clustering.near_links(timed_vectors(spark, sf_dir), 0.33, 3))


@query()
def cluster_stories(spark, sf_dir):
    return clustering.cluster(timed_vectors(spark, sf_dir), 0.33, 0.6, 0.5).select("id", "story")


@query()
def story_rows(spark, sf_dir):
    v = timed_vectors(spark, sf_dir)
    return clustering.assemble(v, clustering.cluster(v, 0.33, 0.6, 0.5), 3.0, 0.2, 0.28, 0.33)


@query()
def related_clusters(spark, sf_dir):
    return clustering.clusters(timed_vectors(spark, sf_dir), 0.33, 0.6, 3.0, 0.2)[1]


@query(f"""WITH {VECTOR}, p AS (SELECT label, v AS p FROM v WHERE id < 5),
s AS (SELECT v.id, p.label, list_dot_product(v.v, p.p) AS sim, row_number() OVER (PARTITION BY v.id ORDER BY round(list_dot_product(v.v, p.p), 9) DESC, p.label DESC) AS rn FROM v, p)
SELECT id, CASE WHEN sim >= 0.1 THEN CAST(label AS VARCHAR) ELSE 'other' END AS label, round(sim, 6) AS sim FROM s WHERE rn = 1""")
def nearest_prototype(spark, sf_dir):
    v = timed_vectors(spark, sf_dir)
    protos = v.where("id < 5").select("label", F.col("vector").alias("prototype"))  # five rows
    return stories.nearest(v.select("id", "vector"), protos, 0.1).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {VECTOR}, p AS (SELECT id AS theme, v AS p FROM v WHERE id < 3), s AS (SELECT v.id, v.label % 3 AS country, theme, list_dot_product(v.v, p.p) AS sim FROM v, p)
SELECT id, theme, round((sim - avg(sim) OVER w) / (stddev_pop(sim) OVER w + 1e-9), 5) AS z FROM s WINDOW w AS (PARTITION BY country, theme)""")
def zscore_themes(spark, sf_dir):
    v = timed_vectors(spark, sf_dir)
    p = v.where("id < 3").select(F.col("id").alias("theme"), F.col("vector").alias("p"))  # three rows
    s = v.crossJoin(F.broadcast(p)).select("id", "country", "theme", vectors.dot("vector", "p").alias("sim"))
    return stories.z_scores(s, "sim", ["country", "theme"]).select("id", "theme", F.round("z", 5).alias("z"))


@query(f"""WITH {VECTOR}, x AS (SELECT label, unnest(v) AS v, generate_subscripts(v, 1) AS p FROM v WHERE id % 2 = 0),
m AS (SELECT label, list(m ORDER BY p) AS c FROM (SELECT label, p, avg(v) AS m FROM x GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT v.id, m.label, list_dot_product(v.v, m.c) AS sim, row_number() OVER (PARTITION BY v.id ORDER BY round(list_dot_product(v.v, m.c), 9) DESC, m.label DESC) AS rn FROM v, m WHERE v.id % 2 = 1)
SELECT id, CASE WHEN sim >= 0.05 THEN CAST(label AS VARCHAR) ELSE 'other' END AS label, round(sim, 6) AS sim FROM s WHERE rn = 1""")
def prior_window_knn(spark, sf_dir):
    v = timed_vectors(spark, sf_dir)
    centres = vectors.mean_vectors(v.where("id % 2 = 0"), ["label"], "vector", "prototype")  # a row a label
    return stories.nearest(v.where("id % 2 = 1").select("id", "vector"), centres, 0.05).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {ARTICLE}, d AS (SELECT *, bool_or(scope = 'domestic') OVER (PARTITION BY story_id) AS dom FROM article),
p AS (SELECT *, similarity + CASE WHEN syndicated_of IS NOT NULL THEN -0.12 ELSE 0 END + CASE WHEN dom AND scope = 'domestic' THEN 0.06 WHEN dom AND scope = 'abroad_local' THEN 0.03 ELSE 0 END
  + CASE WHEN kind IN ('official', 'media', 'wire') THEN 0.04 WHEN kind = 'aggregator' THEN -0.05 ELSE 0 END
  + CASE WHEN factuality IN ('very_high', 'high') THEN 0.04 WHEN factuality = 'mixed' THEN -0.04 ELSE 0 END + 0.03 AS pick FROM d)
SELECT story_id, id, round(pick, 6) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY round(pick, 9) DESC, id) AS rn FROM p) WHERE rn = 1""")
def representative_pick(spark, sf_dir):
    r = stories.representatives(articles(spark, sf_dir).withColumn("sim", F.col("similarity")))
    return r.select("story_id", "id", F.round("pick", 6).alias("pick"))


# Quotations, events, alerts


@query()
def sentence_spans(spark, sf_dir):
    return excerpts.sentences(articles(spark, sf_dir).select("id", "text")).select("id", "ord", "char_start", "char_end")


@query("""SELECT doc_id AS article_id, substr(text, 6, 40) = CASE WHEN doc_id % 7 = 0 THEN 'tampered' ELSE substr(text, 6, 40) END AS ok FROM documents""")
def verify_excerpts(spark, sf_dir):
    a = articles(spark, sf_dir)
    span = F.substring("text", 6, 40)
    e = a.select(F.col("id").alias("article_id"), F.when(F.col("id") % 7 == 0, "tampered").otherwise(span).alias("text"), F.lit(5).alias("char_start"), F.least(F.lit(45), F.length("text")).alias("char_end"))
    return excerpts.verify(e, a).select("article_id", "ok")


@query()
def dedup_events_fuzzy(spark, sf_dir):
    a = articles(spark, sf_dir).select("id", F.col("category").alias("desk"), F.lit("news").alias("kind"), "title", "at")
    return events.dedupe_fuzzy(a, "desk")


@query("""SELECT event_type AS kind, lower(props) AS key, count(*) AS n, list_sort(list_distinct(list(user_id % 5))) AS countries FROM events GROUP BY 1, 2""")
def alerts_dedupe(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("props").alias("title"), (F.col("user_id") % 5).alias("country"), F.col("ts").alias("at"))
    return events.distinct_alerts(e).select("kind", "key", "n", "countries")


@query("""WITH p AS (SELECT conv_id % 20 AS desk, role AS author, conv_id * 1000 + turn AS id, turn AS tm, substr(regexp_replace(lower(text), '[^a-z0-9\\x{00C0}-\\x{024F}\\x{0400}-\\x{04FF}\\x{1E00}-\\x{1EFF}]+', '', 'g'), 1, 64) AS key FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY desk, key ORDER BY tm DESC, id) AS rk FROM p), a AS (SELECT *, row_number() OVER (PARTITION BY desk, author ORDER BY tm DESC, id) AS ra FROM k WHERE key = '' OR rk = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY desk ORDER BY tm DESC, id) AS place FROM a WHERE ra <= 5) SELECT desk, id, place FROM l WHERE place <= 8""")
def social_cap(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    p = c.select((F.col("conv_id") % 20).alias("desk"), F.col("role").alias("author"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("turn").alias("at"), "text")
    return events.cap_posts(p).select("desk", "id", F.col("place").cast("long").alias("place"))


@query("""WITH d AS (SELECT n_nationkey AS desk, n_name AS name FROM nation), e AS (SELECT c_custkey AS event_id, 'NATION_' || (c_custkey % 30) AS place, 'NATION_' || (c_custkey % 7) AS title FROM customer),
m AS (SELECT e.event_id, d.desk, CASE WHEN e.place = d.name THEN 3 WHEN e.title = d.name THEN 1 ELSE 0 END AS priority FROM e JOIN d ON e.place = d.name OR e.title = d.name)
SELECT event_id, desk, priority FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY priority DESC, desk) = 1""")
def desk_assignment(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    p = F.concat(F.lit(r"\b"), "n_name", F.lit(r"\b"))
    desks = n.select(F.col("n_nationkey").alias("desk"), p.alias("any_re"), p.alias("primary_re"), F.lit(None).cast("string").alias("regional_re"), p.alias("country_re"))
    k = F.col("c_custkey")
    e = read(spark, sf_dir, "customer").select(k.alias("event_id"), F.concat(F.lit("NATION_"), (k % 30).cast("string")).alias("place"), F.concat(F.lit("NATION_"), (k % 7).cast("string")).alias("title"))
    return events.assign_desks(e.withColumn("blob", F.concat_ws(" ", "place", "title")), desks)


@query("SELECT event_id, CASE WHEN m >= 6 THEN 'Warning' WHEN m >= 5.5 THEN 'Alert' WHEN m >= 5 THEN 'Caution' END AS level FROM (SELECT event_id, (event_id % 80) / 10 AS m FROM events)")
def quake_levels(spark, sf_dir):
    t = F.concat(F.lit("M "), F.round(F.col("event_id") % 80 / 10, 1).cast("string"), F.lit(" - sea"))
    return read(spark, sf_dir, "events").select("event_id", events.quake_level(t).alias("level"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(to_json({'id': event_id, 'type': event_type}) AS VARCHAR) AS doc FROM events")
def json_round_trip(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query(f"""WITH {ARTICLE} SELECT story_id, id, band, rn FROM (SELECT *, row_number() OVER (PARTITION BY story_id, band ORDER BY (syndicated_of IS NOT NULL)::INT, similarity DESC, tm, id) AS rn FROM (
  SELECT *, CASE WHEN similarity >= 0.93 THEN 'core' WHEN similarity >= 0.85 THEN 'close' ELSE 'broad' END AS band FROM article)) WHERE rn <= CASE band WHEN 'core' THEN 10 WHEN 'close' THEN 8 ELSE 6 END""")
def band_listing(spark, sf_dir):
    band = F.when(F.col("similarity") >= 0.93, "core").when(F.col("similarity") >= 0.85, "close").otherwise("broad")
    w = Window.partitionBy("story_id", "band").orderBy(F.col("syndicated_of").isNotNull().cast("int"), F.desc("similarity"), "at", "id")
    rows = articles(spark, sf_dir).withColumn("band", band).withColumn("rn", F.row_number().over(w).cast("long"))
    return rows.where(F.col("rn") <= F.when(F.col("band") == "core", 10).when(F.col("band") == "close", 8).otherwise(6)).select("story_id", "id", "band", "rn")


@query(f"""WITH {COVERAGE} SELECT row_number() OVER (ORDER BY score DESC, story_id) AS place, '## ' || themes[1] || ': story ' || story_id || ' (' || independent || ' outlets)' AS line
FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, story_id) <= 10""")
def brief_lines(spark, sf_dir):
    line = F.concat(F.lit("## "), F.element_at("themes", 1), F.lit(": story "), F.col("story_id").cast("string"), F.lit(" ("), F.col("independent").cast("string"), F.lit(" outlets)"))
    top = scored(spark, sf_dir).orderBy(F.desc("score"), "story_id").limit(10)
    return top.select(F.row_number().over(Window.orderBy(F.desc("score"), "story_id")).cast("long").alias("place"), line.alias("line"))


@query("""SELECT event_id, round(CASE WHEN x <= 0.78 THEN 0 WHEN x <= 0.86 THEN (x - 0.78) * 0.75 / 0.08 WHEN x <= 0.895 THEN 0.75 + (x - 0.86) * 0.1 / 0.035
  WHEN x <= 0.925 THEN 0.85 + (x - 0.895) * 0.08 / 0.03 WHEN x <= 1 THEN 0.93 + (x - 0.925) * 0.07 / 0.075 ELSE 1 END, 4) AS similarity FROM (SELECT event_id, 0.70003 + (event_id % 350) / 1000.0 AS x FROM events)""")
def calibrated_similarity(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("x", 0.70003 + F.col("event_id") % 350 / 1000.0)
    return e.select("event_id", F.round(text.calibrate("x"), 4).alias("similarity"))


@query(f"""WITH {ARTICLE}, x AS (SELECT story_id, story_id % 5 AS theme, story_id % 5 = 4 AS low, (story_id % 8) / 8.0 AS share, (story_id % 7) - 1.0 AS z, 0.2 * (story_id % 5 + 1) AS weight FROM article GROUP BY ALL)
SELECT story_id, CAST(round(CASE WHEN share >= 0.4 OR z >= 4 THEN weight ELSE 0.3 END, 6) AS DOUBLE) AS policy, CASE WHEN share >= 0.4 OR z >= 4 THEN ['theme ' || theme] ELSE [] END AS themes FROM x""")
def theme_policy(spark, sf_dir):
    s = articles(spark, sf_dir).select("story_id").distinct()
    i = F.col("story_id")
    x = s.select(i, F.concat(F.lit("t"), (i % 5).cast("string")).alias("theme"), F.concat(F.lit("theme "), (i % 5).cast("string")).alias("label"), (0.2 * (i % 5 + 1)).alias("weight"), (i % 5 == 4).alias("low"), (i % 8 / 8.0).alias("share"), ((i % 7) - 1.0).alias("z"))
    return stories.theme_tags(x).select("story_id", F.round("policy", 6).alias("policy"), "themes")


def streamed(spark, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, whether it is a file or a folder of files: a pattern that only its own path matches."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives over all that is there, by way of Parquet in the shared folder; complete mode, or one batch."""
    path = graph.shared_path(stream.sparkSession, "stream")
    done = stream.writeStream.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(path)).option("checkpointLocation", f"{path}-state")
    done.outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query("""SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL""")
def volumes_stream(spark, sf_dir):
    """The events as a stream: available files in one go, daily volumes in complete mode."""
    stream = streamed(spark, sf_dir, "events")
    return drained(streaming.volumes(stream, "event_type"), "complete").withColumn("value", F.round("value", 4))
