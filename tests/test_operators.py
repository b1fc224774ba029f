"""Behaviour of the news operators on small cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire import sources, streaming
from tidewire.functions import patterns, text, vectors
from tidewire.operators import clustering, delta, events, excerpts, graph, ranking, relevance, stories, syndication

NOW = "2024-06-15 12:00:00"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values) or None).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("HTTP://WWW.Example.com//a//b?utm_source=x&id=5&ref=z#top", "http://www.example.com/a/b?id=5"),
        ("https://e.org/?fbclid=1", "https://e.org/"),
        ("no address", "no address"),
        ("https://e.org/p?a=&b=2", "https://e.org/p?a=&b=2"),
    ],
)
def test_clean_url(spark, raw, want):
    assert one(spark, text.clean_url("u"), u=raw) == want


def test_text_functions(spark):
    assert one(spark, text.clean("t"), t="A &amp;amp; <b>B</b>  \U0001f600 ｆｕｌｌ é") == "A & B full é"
    assert one(spark, text.strip_emoji("t"), t="go ☀️ \U0001f1fb\U0001f1f3 x") == "go   x"
    assert one(spark, text.fold("t"), t="ĐÀ Nẵng Łódź ISIĞI") == "da nang lodz isigi"
    assert one(spark, text.title_key("t"), t="Rate-cut: 25 bps!") == "ratecut25bps"
    assert one(spark, text.without_outlet("t", "o"), t="Big news - Daily Post", o="Daily Post") == "Big news"
    assert one(spark, text.url_section("u"), u="https://x.org/World/a") == "world"
    assert one(spark, text.domain("u"), u="https://WWW.x.org/World/a") == "x.org"
    assert one(spark, text.traffic("t"), t="2K+") == 2000 and one(spark, text.traffic("t"), t="1.5M") == 1_500_000
    assert one(spark, text.clip("t", 12), t="one two three four") == "one two…"
    assert one(spark, text.words("t"), t="APEC 会议开 x") == ["apec", "会议", "议开", "x"]
    assert one(spark, text.calibrate("x"), x=0.86) == pytest.approx(0.75) and one(spark, text.calibrate("x"), x=1.2) == 1.0
    assert sorted(one(spark, text.significant_tokens("t"), t="Drones attack Kharkiv ports, ports closed")) == ["closed", "drone", "kharkiv", "port"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Tue, 10 Sep 2024 08:30:00 GMT", dt.datetime(2024, 9, 10, 8, 30)),
        ("9/10/2024 8:30:00 AM", dt.datetime(2024, 9, 10, 1, 30)),
        ("2024-09-10T08:30:00Z", dt.datetime(2024, 9, 10, 8, 30)),
        ("nonsense", None),
    ],
)
def test_dates(spark, raw, want):
    assert one(spark, text.parse_when("d"), d=raw) == want


@pytest.mark.parametrize(
    ("term", "words", "hit"),
    [("Oman", "Oman signs", True), ("Oman", "Romania signs", False), ("中国", "访问中国后", True), ("россия", "РОССИЯ и мир", True), ("APEC", "参加APEC会议", True)],
)
def test_terms(spark, term, words, hit):
    assert one(spark, F.col("t").rlike(patterns.any_term([term])), t=words) is hit


def test_keyword_boundaries(spark):
    r = patterns.keyword_regex(["elección", "scrutin"])
    assert not one(spark, F.col("t").rlike(r), t="la selección gana") and not one(spark, F.col("t").rlike(r), t="under scrutiny")
    assert one(spark, F.col("t").rlike(r), t="las elecciónes")


def test_spam_and_labels(spark):
    assert one(spark, patterns.sports_spam(F.col("t")), t="How to watch A vs B live stream") and not one(spark, patterns.sports_spam(F.col("t")), t="Parliament passes budget")
    assert one(spark, patterns.disaster_label(F.col("t")), t="Typhoon and flood hit") == "Storm & Cyclone"
    assert one(spark, patterns.violence_label(F.col("t")), t="Riot after coup") == "Civil Unrest & Crackdown"
    assert one(spark, patterns.violence_label(F.col("t")), t="Film about a riot") is None


def prose(k, n=120):
    rng = np.random.default_rng(k)
    return " ".join(f"word{int(x)}" for x in rng.integers(0, 5000, n))


def test_reprints(spark):
    a, wire = prose(1), prose(2)
    part = " ".join(wire.split()[:70] + prose(3).split()[:60]) + " (Reuters)"
    cjk = "".join(chr(0x4E00 + int(x)) for x in np.random.default_rng(4).integers(0, 3000, 200))
    rows = [
        (1, "en", "a", 1, a, False), (2, "en", "b", 2, a, False), (3, "fr", "c", 3, a, False), (4, "en", "b", 4, prose(5), False),
        (5, "en", "w", 5, wire, True), (6, "en", "d", 6, part, False), (7, "zh", "x", 7, cjk, False), (8, "zh", "y", 8, cjk, False), (9, "en", "a", 9, "short", False),
    ]
    df = spark.createDataFrame(rows, "id long, country string, source_id string, ord long, content string, wire boolean")
    assert {r.id: r.syndicated_of for r in syndication.reprints(df).collect()} == {2: 1, 6: 5, 8: 7}


def test_texts_are_hashed_in_portions(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"id": list(range(1000))})
    portions = list(syndication._portions([batch, batch.slice(0, 0)]))
    assert max(p.num_rows for p in portions) <= 64 and [i for p in portions for i in p.column("id").to_pylist()] == list(range(1000))
    rows = [(k, prose(k % 7)) for k in range(200)]
    got = syndication._hashed(spark.createDataFrame(rows, "id long, content string").coalesce(1)).collect()
    assert {r.id: list(r.hashes) for r in got} == {k: syndication.shingle_hashes(syndication.content_words(c)).tolist() for k, c in rows}


def test_relevance_cascade(spark):
    rows = [
        ("domestic", None, "https://x/a", "Budget passes", "", "", False, False, True),
        ("domestic", None, "https://x/sport/a", "Budget passes", "", "", False, False, False),
        ("domestic", None, "https://x/world/a", "Elsewhere", "", "", False, False, False),
        ("international", None, "https://x/a", "Malta signs", "", "", False, False, True),
        ("international", None, "https://x/a", "Elsewhere", "", "malta and Malta", False, False, True),
        ("international", None, "https://x/a", "Elsewhere", "", "malta once", False, False, False),
        ("international", None, "https://x/a", "Elsewhere", "", "", False, True, True),
        ("domestic", None, "https://x/a", "Watch live the match", "", "", False, True, False),
    ]
    df = spark.createDataFrame(rows, "scope string, section string, url string, title string, lead string, body string, needs boolean, ev boolean, want boolean")
    c = F.col
    keep = relevance.is_relevant(c("scope"), F.lit(None).cast("string"), c("section"), c("url"), c("title"), c("lead"), c("body"), c("needs"), c("ev"), F.array(F.lit("world")), F.array(F.lit("sport")), F.lit(patterns.any_term(["Malta"])), F.lit("malta"))
    assert [r.got for r in df.select("want", keep.alias("got")).where("want <> got").collect()] == []


def member(story, source, scope="domestic", hours=1.0, sim=1.0, copy=None, kind="media", state=False):
    return (story, source, scope, dt.datetime(2024, 6, 15, 12) - dt.timedelta(hours=hours), sim, copy, kind, state)


MEMBER = "story_id long, source_id string, scope string, at timestamp, similarity double, syndicated_of long, kind string, state_outlet boolean"


def test_scores_prefer_many_outlets_and_elections(spark):
    rows = [member(1, f"s{k}", hours=30) for k in range(5)] + [member(2, "s0")] + [member(3, f"s{k}", hours=30) for k in range(5)]
    facts = spark.createDataFrame([(1, 0.3, ["Trade"]), (2, 1.0, ["Trade"]), (3, 0.3, ["Elections"])], "story_id long, policy double, themes array<string>")
    got = {r.story_id: r.score for r in stories.scores(stories.coverage(spark.createDataFrame(rows, MEMBER), NOW).join(facts, "story_id")).collect()}
    assert got[1] > got[2] and got[3] == pytest.approx(got[1] + 2.5)


@pytest.mark.parametrize(("curr", "prev", "want"), [(3, 0, "new"), (8, 2, "surging"), (1, 6, "cooling"), (3, 3, "steady"), (1, 2, "trace")])
def test_delta_states(spark, curr, prev, want):
    rows = [member(1, "s", hours=5)] * curr + [member(1, "s", hours=24 * 9)] * prev
    r = delta.story_deltas(spark.createDataFrame(rows, MEMBER), NOW, 7).first()
    assert (r.curr, r.prev, r.state) == (curr, prev, want)


def test_shares_are_rounded_as_doubles(spark):
    at = dt.datetime(2024, 6, 14)
    rows = [(1, "s", "domestic", at, 1.0, None, "media", k < 29) for k in range(200)]
    assert delta.story_deltas(spark.createDataFrame(rows, MEMBER), NOW, 7).first().state_share_curr == 0.14  # 0.145 is less


def test_delta_pickup(spark):
    rows = [member(1, "a", hours=24 * 9), member(1, "a"), member(1, "b", scope="international")]
    assert delta.story_deltas(spark.createDataFrame(rows, MEMBER), NOW, 7).first().scope_shift == "international_pickup"


def greedy(items, g_limit, r_limit, c_limit):
    ranked = sorted(items, key=lambda x: (-x["v"], x["id"]))
    cap = 1 if len({x["country"] for x in items}) >= g_limit else c_limit
    out, countries, regions = [], {}, {}
    for x in ranked:
        if len(out) < g_limit and countries.get(x["country"], 0) < cap:
            out.append(x["id"])
            countries[x["country"]] = countries.get(x["country"], 0) + 1
    for x in ranked:
        if x["id"] not in out and countries.get(x["country"], 0) < c_limit and regions.get(x["region"], 0) < r_limit:
            out.append(x["id"])
            countries[x["country"]] = countries.get(x["country"], 0) + 1
            regions[x["region"]] = regions.get(x["region"], 0) + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_quotas_equal_the_greedy_walk(spark, seed):
    rng = np.random.default_rng(seed)
    items = [{"id": k, "country": f"c{int(c)}", "region": f"r{int(c) % 3}", "v": int(v)} for k, (c, v) in enumerate(zip(rng.integers(0, 4 + 4 * (seed % 2), 30), rng.integers(0, 20, 30), strict=True))]
    got = ranking.global_and_regional(spark.createDataFrame(items), [F.desc("v"), F.asc("id")], 6, 3, 2).orderBy("place").collect()
    assert [r.id for r in got] == greedy(items, 6, 3, 2)


def test_breadth_is_that_of_the_c_library(spark):
    """Equal breadths by 0.12 more of log2 and by the bonus for a second outlet differ by their last bit; so it counts."""
    import math

    rows = spark.createDataFrame([(n, d) for n in range(1, 400) for d in (0, 2)], "independent long, domestic long")
    rows = rows.select("*", *(F.lit(0).alias(c) for c in ("abroad_local", "international", "last_24h")), F.lit(1).alias("articles"))
    for r in stories.breadth(rows, F.lit(15.0)).collect():
        assert r.breadth == min(r.independent, 15.0) / 15.0 + 0.12 * math.log2(1 + max(0.0, r.independent - 15.0)) + (0.12 if r.domestic >= 2 else 0.0), r


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y long")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k long, x string, y long")
    assert sorted(tuple(r) for r in ranking.upsert(old, new, "k").collect()) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    more = spark.createDataFrame([(2, "z", 9), (4, "p", 1), (4, "q", 2)], "k long, x string, y long")
    assert [tuple(r) for r in ranking.insert_ignore(more, old, "k", [F.asc("y")]).collect()] == [(4, "p", 1)]


def test_clusters_of_events(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(3, 32))
    rows = []
    for k in range(12):
        v = base[k % 3] + rng.normal(size=32) * 0.08
        rows.append((k, "x", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), [float(t) for t in v]))
    rows.append((12, "x", dt.datetime(2024, 2, 20), [float(t) for t in base[0]]))
    rows.append((13, "y", dt.datetime(2024, 1, 1), [float(t) for t in base[0]]))
    df = spark.createDataFrame(rows, "id long, country string, at timestamp, vector array<double>")
    got = {r.id: r.story for r in clustering.cluster(df).collect()}
    assert all(got[k] == k % 3 for k in range(12)) and got[12] == 12 and got[13] == 13
    assert {(r.a, r.b) for r in clustering.near_pairs(df, 0.92, 3).collect()} == {(i, j) for i in range(12) for j in range(i + 1, 12) if i % 3 == j % 3}


def test_average_linkage_by_components_is_whole():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = rng.integers(0, 5, 40) * 86400.0
    label = clustering.average_linkage(x.copy(), t, 0.1, 259200)
    near = (1 - x @ x.T < 0.1) & (np.abs(t[:, None] - t) <= 259200)
    assert all(any(near[i, j] for j in range(40) if j != i and label[j] == label[i]) for i in range(40) if (label == label[i]).sum() > 1)


def test_bands_take_the_closer_of_centre_and_representative(spark):
    day = dt.datetime(2024, 1, 1)
    centres = spark.createDataFrame([(1, "x", day, day, [1.0, 0.0], [0.0, 1.0])], "story_id long, country string, first_at timestamp, last_at timestamp, centre array<double>, representative array<double>")
    loose = spark.createDataFrame([(7, "x", day, [0.2, 0.9]), (8, "x", day, [0.87, 0.1]), (9, "x", day, [0.5, 0.5])], "id long, country string, at timestamp, vector array<double>")
    got = clustering.attach_bands(centres, loose, 3.0, 0.86, 0.895, 0.925).collect()
    assert {(r.story_id, r.id, r.band, round(r.sim, 6)) for r in got} == {(1, 7, "close", 0.9), (1, 8, "broad", 0.87)}


def test_absorb_small_cluster():
    x = np.array([[1.0, 0.0], [0.97, np.sqrt(1 - 0.97**2)], [0.96, -0.28]])
    size, none = np.array([3, 1, 1]), np.zeros(3, bool)
    near = lambda low, **k: clustering.absorb(x, x, size, np.array(low, float), np.array(low, float), none, 0.9, 10, **k).tolist()
    assert near([0, 0, 0]) == [0, 0, 0]
    assert near([0, 99, 0]) == [0, 1, 0]  # too far in time
    assert near([0, 0, 0], most=1) == [0, 0, 2]  # no room left
    three = np.array([4, 3, 1])
    assert clustering.absorb(x, x, three, np.zeros(3), np.zeros(3), np.array([False, True, False]), 0.9, 10).tolist() == [0, 0, 0]
    assert clustering.absorb(x, x, three, np.zeros(3), np.zeros(3), none, 0.9, 10).tolist() == [0, 1, 0]


def test_centres_merge_where_articles_do_not_meet(spark):
    """Two clusters of eight, 0.925 alike within and 0.894 across: no article of one is near one of the other."""
    rng = np.random.default_rng(3)
    gram = np.full((16, 16), 0.894) + np.eye(16) * 0.075
    gram[:8, :8] += 0.031
    gram[8:, 8:] += 0.031
    x = np.linalg.cholesky(gram) @ np.linalg.qr(rng.normal(size=(16, 16)))[0]
    rows = [(k, "hu", f"2024-01-01 0{k % 8}:00:00", x[k].tolist()) for k in range(16)]
    df = spark.createDataFrame(rows, "id long, country string, at string, vector array<double>").withColumn("at", F.to_timestamp("at"))
    assert {r.story for r in clustering.cluster(df).collect()} == {0}
    core, related = clustering.clusters(df, merge=0.97)
    assert {r.core for r in core.collect()} == {0, 8}
    assert [(r.a, r.b) for r in related.collect()] == [(0, 8)]


def test_stories_with_borrowed_articles(spark):
    def at(cosine, k):
        v = np.zeros(12)
        v[0], v[k] = cosine, np.sqrt(1 - cosine**2)
        return v.tolist()

    vectors_ = [at(0.99, 1), at(0.99, 2), at(0.99, 3), at(0.88, 4), at(0.872, 5), at(0.1, 6)]
    rows = [(k, "hu", "2024-01-01 00:00:00", v) for k, v in enumerate(vectors_)]
    df = spark.createDataFrame(rows, "id long, country string, at string, vector array<double>").withColumn("at", F.to_timestamp("at"))
    got = {(r.story_id, r.id): r.band for r in clustering.assemble(df, clustering.cluster(df)).collect()}
    assert [got[0, k] for k in range(3)].count("core") == 2 and "representative" in got.values()
    assert got[0, 3] == "broad" and got[0, 4] == "broad" and (0, 5) not in got and got[5, 5] == "representative"



def test_components(spark):
    got = graph.components(spark.createDataFrame([(1, 2), (2, 3), (7, 9)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {1: 1, 2: 1, 3: 1, 7: 7, 9: 7}


def test_sentences_and_verification(spark):
    body = "Title line\nThe minister said on Monday that the new harbour would open in the spring of next year. Short one. " + "这是一个足够长的中文句子用来测试分句功能是否正确工作。" + "\nNo end here"
    df = spark.createDataFrame([(1, body), (2, None), (3, "one line only.")], "id long, text string")
    got = excerpts.sentences(df).collect()
    assert len(got) == 2 and all(body[r.char_start : r.char_end] == r.sentence for r in got)
    e = excerpts.sentences(df).select(F.col("id").alias("article_id"), F.col("sentence").alias("text"), "char_start", "char_end")
    assert [r.ok for r in excerpts.verify(e, df).collect()] == [True, True]
    bad = e.withColumn("text", F.concat("text", F.lit("!")))
    assert [r.ok for r in excerpts.verify(bad, df).collect()] == [False, False]


def test_choose_quotes(spark):
    rows = [(1, k, 0, s, sc, v) for k, (s, sc, v) in enumerate([("a", "domestic", 0.9), ("a", "domestic", 0.8), ("b", "domestic", 0.85), ("c", "international", 0.2), ("d", "domestic", 0.7)])]
    got = excerpts.choose(spark.createDataFrame(rows, "story_id long, id long, ord int, source_id string, scope string, score double")).orderBy("place").collect()
    assert [r.id for r in got] == [0, 3, 2]


def test_fuzzy_events(spark):
    at = dt.datetime(2024, 1, 5)
    rows = [(1, "d", "news", "Rocket hits harbour depot in Odesa", at), (2, "d", "news", "Harbour depot in Odesa burns", at - dt.timedelta(hours=1)), (3, "d", "news", "Flood warning for coastal towns", at - dt.timedelta(hours=2))]
    got = events.dedupe_fuzzy(spark.createDataFrame(rows, "id long, desk string, kind string, title string, at timestamp"), "desk").collect()
    assert sorted(r.id for r in got) == [1, 3]


def test_batches(spark):
    df = spark.createDataFrame([(f"d{k}", n) for k, n in enumerate([5, 5, 5, 5, 1, 1, 1, 1, 1])], "desk string, n_items int")
    got = {r.desk: r.batch for r in events.pack_batches(df).collect()}
    assert [got[f"d{k}"] for k in range(9)] == [0, 0, 0, 1, 1, 1, 1, 1, 1]


def test_catalog_and_sources(spark, tmp_path):
    pack = {"id": "mt", "name": "Malta", "mention": ["Malta"], "sources": [{"id": "s1", "feeds": [{"url": "u1"}]}]}
    assert sources.catalog(spark, [pack])["source"].count() == 1
    with pytest.raises(ValueError, match="s1"):
        sources.catalog(spark, [pack, pack | {"id": "xx"}])
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><link>https://x.org/a?utm_source=q</link><pubDate>Tue, 10 Sep 2024 08:30:00 GMT</pubDate></item></channel></rss>")
    r = sources.rss(spark, str(tmp_path / "f.xml")).first()
    assert (r.title, r.url, r["at"]) == ("A & B", "https://x.org/a", dt.datetime(2024, 9, 10, 8, 30))
    (tmp_path / "e.tsv").write_text("\t".join(["1"] + ["x"] * 25 + ["190", "190", "19"] + ["x"] * 23 + ["Odesa"] + ["x"] * 7 + ["https://n.org/a#b"]) + "\n" + "\t".join(["2"] + ["x"] * 60) + "\n")
    got = sources.event_table(spark, str(tmp_path / "e.tsv")).collect()
    assert [(r.event_id, r.place, r.url) for r in got] == [("1", "Odesa", "https://n.org/a")]
    body = spark.createDataFrame([('{"events":[{"id":"e","title":"Fire","geometry":[{"date":"2024-01-01T00:00:00Z","coordinates":[1.0,2.0]},{"date":"2024-01-02T00:00:00Z","coordinates":[3.0,4.0]}]}]}',)], "body string")
    assert sources.json_events(body).first().coordinates == [3.0, 4.0]
    page = "<html><head><title>Plain title of a page</title><meta property='og:title' content='Shown title'></head><body><nav>Menu entries that are long enough</nav><p>A first paragraph that is long enough to be kept.</p><script>var x='</p>'</script></body></html>"
    m = sources.page_meta(spark.createDataFrame([(page,)], "html string")).select("meta_title", sources.main_text("html").alias("t")).first()
    assert m.meta_title == "Shown title" and m.t == "A first paragraph that is long enough to be kept."
    items = sources.rss_items(spark.createDataFrame([("A < B", "https://x/?a=1&b=2", dt.datetime(2024, 1, 2))], "title string, url string, at timestamp")).first().item
    assert "A &lt; B" in items and "&amp;b=2" in items
    sources.export_json(spark.createDataFrame([(1, None)], "a long, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":null}'


def test_robots_and_status(spark):
    df = spark.createDataFrame([(200, True), (200, False), (404, False), (500, True), (0, True)], "code int, allow boolean")
    assert [r[0] for r in df.select(sources.robots_policy(F.col("code"), F.col("allow"))).collect()] == [True, False, True, False, False]


def test_streams(spark, tmp_path):
    streaming.needs_rocksdb(spark)
    t = dt.datetime(2024, 1, 1)
    rows = [(f"https://x.org/{k % 3}?utm_source={k}", t + dt.timedelta(minutes=k)) for k in range(9)]
    spark.createDataFrame(rows, "url string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("url string, at timestamp").parquet(str(tmp_path / "in"))
    q = streaming.unique_articles(s).writeStream.format("memory").queryName("unique_urls").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.url for r in spark.table("unique_urls").collect()) == [f"https://x.org/{k}" for k in range(3)]
    polls = [("f", t + dt.timedelta(hours=k), k > 6) for k in range(8)]
    spark.createDataFrame(polls, "feed string, at timestamp, ok boolean").coalesce(1).write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema("feed string, at timestamp, ok boolean").parquet(str(tmp_path / "p"))
    q = streaming.feed_states(s).writeStream.format("memory").queryName("feed_states").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("feed_states").orderBy("at").collect()
    assert [r.errors for r in got] == [1, 2, 3, 4, 5, 6, 7, 0]
    assert [(r.retry_after - r["at"]).total_seconds() / 3600 if r.retry_after else None for r in got] == [None, None, 6, 12, 24, 48, 48, None]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "g string, v array<double>")
    assert {r.g: r.centroid for r in vectors.mean_vectors(df, ["g"], "v").collect()} == {"a": [2.0, 3.0], "b": [5.0, 6.0]}


def test_gates(spark):
    from tidewire.operators import feeds

    now = F.lit("2024-01-10").cast("timestamp")
    df = spark.createDataFrame([("https://n.org/drone-attack/x", "Shelling kills five in the east"), ("https://n.org/a", "Film about soldiers killed"), ("https://n.org/a", "Army; navy; air force; killed")], "url string, title string")
    assert [r[0] for r in df.select(feeds.conflict_gate(F.col("url"), F.col("title"))).collect()] == [True, False, False]
    assert one(spark, feeds.summary(F.lit("USGS"), F.col("t")), t="Location 10.5°N 20.1°E Depth 12.0 km") == "Epicenter 10.5°N 20.1°E · Depth 12.0 km"
    assert one(spark, feeds.summary(F.lit("US travel advisory"), F.col("t")), t="Level 3. Reconsider travel due to unrest. More.") == "Reconsider travel due to unrest."
    assert one(spark, feeds.summary(F.lit("x"), F.col("t")), t="<p>First one</p> . Second") == "First one."
    assert one(spark, feeds.clean_body(F.col("t")), t="<p>Body &amp; more</p> submitted by /u/x [link]") == "Body & more"
    assert one(spark, feeds.glossary(F.col("t"), [("colour", "color")]), t="the colour red") == "the color red" and one(spark, feeds.glossary(F.col("t"), []), t="ab") is None
    posts = spark.createDataFrame([("c", '<div data-post="c/1"><div class="tgme_widget_message_text x">A message long enough to be <b>kept</b></div><time datetime="2024-01-02T03:04:05+00:00"></div>')], "slug string, html string")
    r = feeds.channel_posts(posts).first()
    assert (r.post_id, r.text, r["at"]) == ("c/1", "A message long enough to be kept", dt.datetime(2024, 1, 2, 3, 4, 5))
    when = spark.createDataFrame([(dt.datetime(2024, 1, 8),), (dt.datetime(2023, 1, 1),), (None,)], "at timestamp")
    assert [r[0] for r in when.select(feeds.recent(F.col("at"), now)).collect()] == [True, False, False]


def test_http_source(spark):
    import http.server
    import threading

    from tidewire.sources.http import HttpSource

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            known = self.headers.get("If-None-Match") == "v1"
            self.send_response(304 if known else 404 if self.path == "/gone" else 200)
            self.send_header("ETag", "v1")
            self.end_headers()
            if not known:
                self.wfile.write(b"hello")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(HttpSource)
    urls = "\n".join([f"{root}/a", f"{root}/b\tv1\t", f"{root}/gone", "http://127.0.0.1:1/none"])
    got = {r.url[len(root) :] if r.url.startswith(root) else r.url: r for r in spark.read.format("tidewire_http").option("urls", urls).option("timeout", "5").load().collect()}
    server.shutdown()
    assert (got["/a"].status, bytes(got["/a"].body), got["/a"].etag) == (200, b"hello", "v1")
    assert got["/b"].status == 304 and got["/gone"].status == 404 and got["http://127.0.0.1:1/none"].status == 0


def test_conflicts_merge_once(spark):
    from tidewire.operators import events

    ev = [(1, "Clash in Alpha", "Alpha City", "https://www.Paper.al/a?utm_source=z", None, "Paper", None), (2, "again", "Alpha City", "https://paper.al/a", "t" * 300, None, None),
          (3, "Far", "Beta", "https://paper.al/b", "short", None, "lead"), (4, "Nobody", "Nowhere", "https://paper.al/c", None, None, None), (5, "Alpha", "", "no address", None, None, None), (6, "Alpha", "", "https://known.org/x", "t" * 201, None, None)]
    df = spark.createDataFrame(ev, "event_id long, title string, place string, url string, text string, site string, lead string")
    df = df.withColumn("at", F.lit(dt.datetime(2024, 1, 1))).withColumn("blob", F.concat_ws(" ", "place", "title"))
    desks = spark.createDataFrame([("alpha", "(?i)alpha", "(?i)alpha city", None, "(?i)alpha", "al"), ("beta", "(?i)beta", "(?i)beta", None, "(?i)beta", "be")], "desk string, any_re string, primary_re string, regional_re string, country_re string, geo string")
    outlets = spark.createDataFrame([("alpha", 0, "k", "https://known.org/", "hu", "abroad_local")], "country string, place int, id string, homepage string, language string, scope string")
    s_kind = "id string, name string, homepage string, language string, scope string, bias string, alignment string, factuality string"
    a_kind = "url string, source_id string, country string, title string, lead string, text string, language string, at timestamp, status string, relevant boolean"
    sources = spark.createDataFrame([("k", "Known", "https://known.org/", "hu", "abroad_local", "left", "x", "y"), ("gdelt:paper.al", "Old", "https://paper.al", "sq", "international", "right", None, "high")], s_kind)
    articles = spark.createDataFrame([("https://paper.al/b", "p", "beta", "T", "", None, "sq", None, "pending", False), ("https://other.org/", "p", "beta", "T", "", "text", "sq", None, "ok", None)], a_kind)
    ratings = spark.createDataFrame([(1, "Paper", "center", "independent", "mixed")], "ord int, name string, bias string, alignment string, factuality string")
    got = events.merge_conflicts(df, desks, outlets, sources, articles, ratings)
    s = {r.id: r for r in got[0].collect()}
    assert sorted(s) == ["gdelt:paper.al", "k"] and s["k"].scope == "abroad_local" and s["k"].bias == "left"
    assert (s["gdelt:paper.al"].scope, s["gdelt:paper.al"].name, s["gdelt:paper.al"].bias) == ("domestic", "Old", "center")
    told = {r.url: (r.source_id, r.country, r.status, len(r.text or ""), r.relevant) for r in got[1].collect()}
    assert told == {"https://www.paper.al/a": ("gdelt:paper.al", "alpha", "pending", 0, True), "https://paper.al/a": ("gdelt:paper.al", "alpha", "ok", 300, True),
                    "https://paper.al/b": ("p", "beta", "ok", 5, True), "https://other.org/": ("p", "beta", "ok", 4, False), "https://known.org/x": ("k", "alpha", "ok", 201, True)}
    again = events.merge_conflicts(df, desks, outlets, *got, ratings)
    for before, after in zip(got, again):
        assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_terms_in_one_pass(spark, monkeypatch):
    from tidewire.functions import terms

    rows = [(1, "South Korea's talks"), (2, "southkorea"), (3, "在南韓的"), (4, "Côte d'Ivoire, Seoul"), (5, None), (6, ""), (7, "A_seoul seoul_ seoul2"), (8, "韓Seoul韓 and south korea")]
    texts = spark.createDataFrame(rows, "id long, text string")
    catalog = spark.createDataFrame([(0, "south korea"), (1, "南韓"), (2, "SEOUL"), (3, "côte d'ivoire"), (4, "korea"), (5, "seoul"), (6, None), (7, " ")], "number long, term string")
    want = [(1, 0), (1, 4), (3, 1), (4, 2), (4, 3), (4, 5), (8, 0), (8, 2), (8, 4), (8, 5)]
    assert sorted(map(tuple, terms.found_terms(texts, catalog).collect())) == want
    for c in (t for _, t in catalog.collect() if t and t.strip()):  # as the patterns of single terms say
        by_pattern = {r.id for r in texts.where(F.col("text").rlike(patterns.any_term([c]))).collect()}
        numbers = {r.number for r in catalog.collect() if r.term == c}
        assert by_pattern == {i for i, n in want if n in numbers}
    monkeypatch.setattr(terms, "MOST_TERMS", 2)  # several passes
    assert sorted(map(tuple, terms.found_terms(texts, catalog).collect())) == want
    assert terms.found_terms(texts, catalog.limit(0)).count() == 0


def test_nearest_centres_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(60, 5)), rng.normal(size=(17, 5))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[9] = c[4]
    rows = spark.createDataFrame([(k, "ab"[k % 2], x[k].tolist()) for k in range(60)] + [(99, "a", None), (98, "z", [1.0] * 5), (97, None, [1.0] * 5)], "id long, country string, vector array<double>")
    centres = spark.createDataFrame([(k, "ab"[k % 3 == 0], c[k].tolist()) for k in range(17)], "story_id long, country string, centre array<double>")
    want = {}
    for k in range(60):
        best = max((round(float(x[k] @ c[j]), 9), -j) for j in range(17) if "ab"[j % 3 == 0] == "ab"[k % 2])
        want[k] = (-best[1], best[0])
    for blocks in ((4096, 1024), (7, 3)):
        monkeypatch.setattr(stories, "ROW_BLOCK", blocks[0])
        monkeypatch.setattr(stories, "CENTRE_BLOCK", blocks[1])
        assert {r.id: (r.story_id, round(r.sim, 9)) for r in stories.nearest_centres(rows, centres).collect()} == want


def test_absorbed_clusters_follow_the_chain(spark):
    turn = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    x = np.array([turn(0), turn(24), turn(48)])
    assert clustering.absorb(x, x, np.array([1, 2, 3]), np.zeros(3), np.zeros(3), np.zeros(3, bool), 0.895, 10).tolist() == [2, 2, 2]
    rows = [(k, "hu", f"2024-01-01 0{k}:00:00", turn(d)) for k, d in enumerate((0, 24, 24, 48, 48, 48))]
    df = spark.createDataFrame(rows, "id long, country string, at string, vector array<double>").withColumn("at", F.to_timestamp("at"))
    assert {r.id for r in clustering.assemble(df, clustering.cluster(df)).collect()} == set(range(6))
