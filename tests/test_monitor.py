"""The event monitor, quoted sentences and the country index on cases made by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import catalog, excerpts, monitor

STORY = (
    "id long, title string, en_title string, titles array<string>, themes array<string>, category string, last_seen timestamp, "
    "disaster_type string, violence_type string, traditions array<string>"
)


def stories(spark, *rows):
    names = [f.split()[0] for f in STORY.split(", ")]
    given = [tuple({"id": k, **row}.get(n) for n in names) for k, row in enumerate(rows)]
    return spark.createDataFrame(given, STORY).withColumn("last_seen", F.coalesce("last_seen", F.lit("2024-01-01").cast("timestamp")))


def tags(spark, *rows):
    got = monitor.tagged(stories(spark, *rows)).orderBy("id").collect()
    return [(r.disaster_type, r.violence_type, r.traditions) for r in got]


def test_tags_of_titles(spark):
    assert tags(
        spark,
        {},
        {"title": "Church burned in a raid", "titles": [None, "Mosque attack"]},
        {"title": "A church opens", "titles": ["Two killed in the north"]},  # not in one title
        {"title": "Choir of the cathedral", "titles": ["Imam and rabbi flee, gunmen shot at the synagogue"]},
        {"title": "Church raid: the film"},
        {"title": "Động đất và SÓNG THẦN"},
        {"title": "Vụ việc", "en_title": "Militants near a flood"},
        {"title": None, "en_title": "Mosque attack"},  # a translation of nothing
        {"title": "Shot fired", "themes": ["Regional security"]},
        {"title": "Shot fired", "category": "defence_security"},
        {"title": "Shot fired"},
        {"title": "Typhoon", "themes": ["Sport and culture"], "violence_type": "given"},
        {"title": "Flood", "disaster_type": "given", "traditions": []},
        {"title": "Quiet", "titles": ["x", "y", "z", "Earthquake"]},  # the fourth outlet isn't asked
    ) == [
        (None, None, None),
        (None, None, ["Christianity"]),
        (None, None, None),
        (None, "Armed Clash & Strike", ["Judaism", "Islam"]),
        (None, None, None),
        ("Earthquake & Volcano", None, None),
        ("Flood & Landslide", "Insurgency & Terror", None),
        (None, None, None),
        (None, "Armed Clash & Strike", None),
        (None, "Armed Clash & Strike", None),
        (None, None, None),
        (None, "given", None),
        ("given", None, []),
        (None, None, None),
    ]


def test_tracks(spark):
    rows = stories(
        spark,
        {"violence_type": "Armed Clash & Strike", "title": "Curfew", "traditions": ["Islam"]},
        {"violence_type": "Armed Clash & Strike", "title": "A concert", "traditions": ["Other Faiths & Sites"]},
        {"titles": ["a", "b", "c", "Hostage freed", "Riot"]},
        {},
    )
    got = [r.tracks for r in monitor.tracks(rows).orderBy("id").collect()]
    assert got == [["rel_all", "rel_islam", "armed_clash", "unrest"], ["rel_all", "rel_other"], ["insurgency"], []]
    alerts = [(0, None, None, None, "Church attack", None), (1, "Mali", "Africa", "x", "Church", "militants"), (2, None, None, None, "Riot at the match", None), (3, None, None, None, "Imam", ""), (4,) + (None,) * 5]
    got = monitor.alert_tracks(spark.createDataFrame(alerts, "id long, country_name string, region string, kind string, title string, summary string"))
    assert [r.tracks for r in got.orderBy("id").collect()] == [["rel_all", "rel_christian"], ["rel_all", "rel_christian", "insurgency"], [], [], []]


def test_event_pool(spark):
    first = stories(spark, {"id": 1, "title": "Quiet"}, {"id": 2, "title": "Flood A"}, {"id": 3, "title": "Riot"}, {"id": None, "title": "Flood"})
    every = stories(
        spark, {"id": 1, "title": "Flood B"}, {"id": 2, "title": "Flood C"}, {"id": 4, "themes": [monitor.VIOLENT[0]]}, {"id": 5, "title": "Flood", "category": "sport_culture"}, {"id": None, "title": "Flood"}, {"id": 1, "title": "Flood B"}
    )
    got = monitor.event_pool([first, every], "disasters").select("id", "title").collect()
    assert sorted((r.id or 0, r.title) for r in got) == [(0, "Flood"), (0, "Flood"), (1, "Flood B"), (2, "Flood A")]
    assert sorted(r.id for r in monitor.event_pool([first, every], "violence").collect()) == [3, 4]
    assert monitor.event_pool([first, every], "violence", F.lit("2024-01-02").cast("timestamp")).count() == 0
    assert monitor.event_pool([first.limit(0), every.limit(0)], "disasters").count() == 0


def walk(text):
    """Sentences of all lines but the first, character by character: where a mark and a space, or a mark of an unspaced
    script with the closing quote behind it, ends them."""
    out, lines, at = [], [], 0
    for line in text.split("\n"):
        if line:
            lines.append((at, line))
        at += len(line) + 1
    for base, line in lines[1:]:
        begin, k = 0, 0
        while k < len(line):
            last = k + 1 == len(line)
            behind = "" if last else line[k + 1]
            ends = last or (line[k] in ".!?…" and behind.isspace()) or (line[k] in "。！？" and behind not in "”」』）)") or (k and line[k - 1] in "。！？" and line[k] in "”」』）")
            if ends:
                s = line[begin : k + 1].strip()
                if s:
                    low = 20 if any("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in s) else 60
                    if low <= len(s) <= 320 and s[-1] in '.!?…"”。！？」』' and not line[begin : k + 1][-1].isspace():
                        start = base + begin + line[begin : k + 1].index(s)
                        out.append((start, start + len(s)))
                begin = k + 1
            k += 1
    return out[:8]


@pytest.mark.parametrize("seed", range(40))
def test_spans_equal_a_walk(seed):
    r = random.Random(seed)
    words = ["the harbour was opened again", "on monday", "这是一个足够长的中文句子用来测试分句功能", "3.5 per cent", "“yes”", "ministers of the seven countries said nothing"]
    ends = [". ", "! ", "…  ", "。", "。”", "？）", ".", '." ', "\n", "\n\n", " ", ", ", ".\n"]
    text = "".join(r.choice(words) + r.choice(ends) for _ in range(90))
    assert excerpts.sentence_spans(text) == walk(text)


def test_places_datelines_and_noise():
    body = "hành khách chờ đợi nhiều giờ liền tại sân bay vì bão lớn đổ bộ vào đất liền."

    def said(t, **patterns):
        whole = "Headline\n" + t
        return [whole[a:b] for a, b in excerpts.sentence_spans(whole, **patterns)]

    assert said("  Đồng NaiH" + body[1:]) == ["H" + body[1:]]
    assert said("McDonald " + body) == ["McDonald " + body]  # one word only
    assert said("of NaiH" + body[1:]) == ["of NaiH" + body[1:]]
    assert said("VOV.VN - " + body, dateline=r"[a-z.]+ - ") == [body]
    assert said("Đồng NaiVOV.VN - " + body, dateline=r"[a-z.]+ - ") == [body]
    assert said("Photo: " + body + " H" + body[1:], noise="photo") == ["H" + body[1:]]
    assert excerpts.glued_place("") == excerpts.glued_place("Aa") == 0 and excerpts.sentence_spans(None) == excerpts.sentence_spans("\n\n") == []
    assert said(("H" + body[1:] + " ") * 100_000) == ["H" + body[1:]] * 8


def test_sentences_by_desk(spark):
    text = "Headline\nREUTERS - The minister said on Monday that the new harbour would open in the spring."
    a = spark.createDataFrame([(1, "x", text), (2, "y", text), (3, None, text), (4, "x", None)], "id long, country string, text string")
    desks = spark.createDataFrame([("x", "reuters - ", None), ("y", None, "reuters")], "country string, dateline string, noise string")
    got = {r.id: r.sentence for r in excerpts.sentences(a, desks).collect()}
    assert got == {1: text[19:], 3: text[9:]}


def test_scores_by_centre_and_quotation(spark):
    members = spark.createDataFrame(
        [(1, 1, [1.0, 0.0], 1.0, "t", None), (1, 2, [0.0, 1.0], None, "t", None), (1, 3, [-9.0, 0.0], 0.9, "t", None), (1, 4, [-9.0, 0.0], 1.0, None, None), (1, 5, [-9.0, 0.0], 1.0, "t", 1)],
        "story_id long, id long, vector array<double>, similarity double, text string, syndicated_of long",
    )
    said = [(1, 1, "They stated it", [1.0, 0.0]), (1, 2, "No", [0.6, 0.8]), (1, 3, "said", [1.0, 0.0]), (2, 1, "said", [1.0, 0.0]), (1, 1, "宣布了", [0.0, 1.0])]
    got = excerpts.scored(spark.createDataFrame(said, "story_id long, id long, sentence string, vector array<double>"), members).collect()
    half = 0.5**0.5
    assert {r.sentence: round(r.score, 9) for r in got} == {"They stated it": round(half + 0.02, 9), "No": round(1.4 * half, 9), "宣布了": round(half + 0.02, 9)}


def test_country_index(spark):
    countries = spark.createDataFrame(
        [("hu", "Hungary", None, "hu", "abroad", ["HUNGARY", "Budapest", None]), ("xx", "Nowhere", "R", None, None, None), ("vn", "Vietnam", "Asia", None, None, [str(k) for k in range(20)])],
        "id string, name string, region string, language string, abroad_label string, mention array<string>",
    )
    periods = spark.createDataFrame([("hu", "day", "Today", 1), ("hu", "week", "This week", 7), ("hu", "week", "This week", 7), ("vn", "day", None, 1)], "id string, period string, label string, days int")
    got = {r.id: r for r in catalog.country_index(countries, periods).collect()}
    assert set(got) == {"hu", "vn"} and got["hu"].region == "Other" and got["hu"].mentions == ["hungary", "budapest"]
    assert [(p.id, p.label, p.file) for p in got["hu"].periods] == [("week", "This week", "hu-week.json"), ("day", "Today", "hu-day.json")]
    assert got["vn"].mentions == ["vietnam"] + [str(k) for k in range(12)]
