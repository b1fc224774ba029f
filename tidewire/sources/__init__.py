"""Readers and writers: feeds, event tables, pages, catalogs, exports."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

#: Feed items of RSS 2.0 as the XML reader gives them.
RSS_ITEM = "title string, link string, description string, pubDate string, category string"


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: (title, url, summary, at, section), cleaned."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)
    return raw.select(
        text.clean("title").alias("title"), text.clean_url("link").alias("url"), text.clean("description").alias("summary"),
        text.parse_when("pubDate").alias("at"), F.col("category").alias("section"),
    )


def event_table(spark: SparkSession, path: str) -> DataFrame:
    """Conflict events of tab-separated event files without a header: by code, with an address."""
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"c{k} string" for k in range(61)))
    e = raw.select(F.col("c0").alias("event_id"), F.col("c26").alias("code"), F.col("c27").alias("base"), F.col("c28").alias("root"), F.col("c52").alias("place"), F.col("c60").alias("url"))
    return e.where(F.col("root").isin("18", "19", "20") | F.col("base").isin("145", "175")).withColumn("url", text.clean_url("url"))


def json_events(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Natural events of a JSON body: one row per event with its latest geometry."""
    schema = "events array<struct<id:string,title:string,geometry:array<struct<date:string,coordinates:array<double>>>>>"
    e = bodies.select(F.explode(F.from_json(column, schema)["events"]).alias("e"))
    last = F.element_at("e.geometry", -1)
    return e.select("e.id", "e.title", F.try_to_timestamp(last["date"]).alias("at"), last["coordinates"].alias("coordinates"))


def catalog(spark: SparkSession, packs: list[dict]) -> dict[str, DataFrame]:
    """Dimension tables of desk packs: pack, source, feed, mention. Ids that occur twice raise."""
    sources = [(s["id"], p["id"], s.get("name"), s.get("language"), s.get("scope"), s.get("kind")) for p in packs for s in p.get("sources", [])]
    feeds = [(f["url"], s["id"], p["id"], f.get("section"), f.get("category_hint")) for p in packs for s in p.get("sources", []) for f in s.get("feeds", [])]
    for what, ids in (("source", [s[0] for s in sources]), ("feed", [f[0] for f in feeds])):
        twice = sorted({i for i in ids if ids.count(i) > 1})
        if twice:
            raise ValueError(f"{what} given twice: {', '.join(map(str, twice))}")
    make = spark.createDataFrame
    return {
        "pack": make([(p["id"], p.get("name"), p.get("region"), p.get("language")) for p in packs], "id string, name string, region string, language string"),
        "source": make(sources, "id string, country string, name string, language string, scope string, kind string"),
        "feed": make(feeds, "url string, source_id string, country string, section string, category_hint string"),
        "mention": make([(p["id"], k, m) for p in packs for k, m in enumerate(p.get("mention", []))], "country string, ord int, term string"),
    }


def page_meta(pages: DataFrame, column: str = "html", most: int | None = None) -> DataFrame:
    """``pages`` with meta_title, meta_lead and site of each whole page, or of its first ``most`` characters."""
    head = F.substring(column, 1, most) if most else F.col(column)
    meta = lambda p: F.nullif(F.regexp_extract(head, rf'(?is)<meta[^>]+property=["\']{p}["\'][^>]+content=["\']([^"\']*)', 1), F.lit(""))
    title = F.coalesce(meta("og:title"), F.nullif(F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))
    return pages.withColumn("meta_title", text.squash(title)).withColumn("meta_lead", text.squash(meta("og:description"))).withColumn("site", meta("og:site_name"))


class _Main(HTMLParser):
    SKIP = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
    BLOCK = {"p", "div", "br", "li", "h1", "h2", "h3", "article", "section", "tr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.depth += 1
        elif tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.depth:
            self.depth -= 1
        elif tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def _main_text(page: str | None) -> str:
    if not page:
        return ""
    p = _Main()
    p.feed(page)
    lines = (" ".join(x.split()) for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in lines if len(x) > 25)


@F.pandas_udf(T.StringType())
def main_text(s: pd.Series) -> pd.Series:
    """Readable lines of a page without scripts, menus and forms."""
    return s.map(_main_text)


def extract_status(code: Column, allowed: Column, body: Column, least: int = 200) -> Column:
    """What became of a page: ok, empty, robots or its HTTP code."""
    return F.when(~allowed, "robots").when(code != 200, F.concat(F.lit("http"), code.cast("string"))).when(F.length(body) > least, "ok").otherwise("empty")


def robots_policy(code: Column, rules_allow: Column) -> Column:
    """Allowed by a parsed file, or where there is none (404, 410); anything else keeps out."""
    return F.when(code == 200, rules_allow).otherwise(code.isin(404, 410))


def export_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def rss_items(df: DataFrame) -> DataFrame:
    """Rows (title, url, at) as escaped RSS items."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.date_format("at", "dd MMM yyyy HH:mm:ss")
    return df.select(F.concat(F.lit("<item><title>"), esc("title"), F.lit("</title><link>"), esc("url"), F.lit("</link><pubDate>"), day, F.lit(" +0000</pubDate></item>")).alias("item"))


