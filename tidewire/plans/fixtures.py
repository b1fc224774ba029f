"""Adapters: the given tables as articles, sources, story members and events.

What the tables lack follows from ids by arithmetic, the same in SQL (``ARTICLE`` and so on are CTEs for that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delta import CATEGORIES

NOW = "2024-01-30 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, by):
    return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))


SCOPES, KINDS = ["domestic", "abroad_local", "international"], ["media", "wire", "official", "aggregator"]
FACTS, SIMS = ["high", "mixed", "unrated", "very_high", "low"], [1.0, 0.95, 0.93, 0.9, 0.8]


def articles(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    d, i = read(spark, sf_dir, "documents") if docs is None else docs, F.col("doc_id")
    n = F.substring("source", 4, 9).cast("int")
    line = lambda k: F.split_part("text", F.lit("\n"), F.lit(k))
    return d.select(
        i.alias("id"), F.col("lang").alias("country"), F.col("source").alias("source_id"), line(1).alias("title"), line(2).alias("lead"), "text",
        F.expr("timestamp '2024-01-01' + make_dt_interval(0, cast(doc_id % 696 as int))").alias("at"),
        pick(SCOPES, n).alias("scope"), pick(KINDS, n).alias("kind"), pick(FACTS, n).alias("factuality"), (n % 4 == 1).alias("state_outlet"),
        F.when(i % 11 == 0, i - 1).alias("syndicated_of"), pick(CATEGORIES, i).alias("category"),
        (i % 37).alias("story_id"), pick(SIMS, i).alias("similarity"), F.concat(F.lit("https://news.example/"), "lang", F.lit("/"), i.cast("string")).alias("url"),
    )


def _case(values: list, by: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({by} % {len(values)} AS INTEGER) + 1]"


ARTICLE = f"""article AS (
  SELECT doc_id AS id, lang AS country, source AS source_id, split_part(text, chr(10), 1) AS title, split_part(text, chr(10), 2) AS lead, text,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 696 AS INTEGER)) AS tm,
    {_case(SCOPES, "CAST(substr(source, 4) AS INTEGER)")} AS scope, {_case(KINDS, "CAST(substr(source, 4) AS INTEGER)")} AS kind,
    {_case(FACTS, "CAST(substr(source, 4) AS INTEGER)")} AS factuality, CAST(substr(source, 4) AS INTEGER) % 4 = 1 AS state_outlet,
    CASE WHEN doc_id % 11 = 0 THEN doc_id - 1 END AS syndicated_of, {_case(CATEGORIES, "doc_id")} AS category,
    doc_id % 37 AS story_id, CAST({_case(SIMS, "doc_id")} AS DOUBLE) AS similarity, 'https://news.example/' || lang || '/' || doc_id AS url
  FROM documents)"""


def story_facts(spark: SparkSession) -> DataFrame:
    """Policy and themes of the 37 stories."""
    s = spark.range(37).withColumnRenamed("id", "story_id")
    return s.select("story_id", (F.col("story_id") % 10 / 10).alias("policy"), F.when(F.col("story_id") % 9 == 0, F.array(F.lit("National elections"))).otherwise(F.array(F.lit("Trade"))).alias("themes"))


FACTS_SQL = """story AS (
  SELECT range AS story_id, range % 10 / 10.0 AS policy, CASE WHEN range % 9 = 0 THEN ['National elections'] ELSE ['Trade'] END AS themes
  FROM range(37))"""
