"""Quotations that can be verified character by character."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed_values as fixed
from ..functions import patterns, vectors
from .graph import small

_CJK = re.compile("[぀-ヿ一-鿿]")
_END = re.compile(fixed.SENTENCE_END)
_CLOSED = ".!?…\"”。！？」』"
#: What a sentence gains by a mark or verb of quotation.
CUE = 0.02


def glued_place(s: str) -> int:
    """How many characters of a place name of two words or more stand right before the sentence, without a space; else 0.

    The first small letter with a capital behind it, within the first 24 characters, tells: "Đồng NaiHành khách" has 8.
    """
    at = next((i for i in range(4, min(len(s), 25)) if s[i - 1].islower() and s[i].isupper()), 0)
    words = s[:at].split(" ")
    return at if len(words) > 1 and all(w[:1].isupper() for w in words) else 0


@lru_cache(maxsize=1024)
def _pattern(p: str) -> re.Pattern:
    return re.compile(p, re.IGNORECASE)


def sentence_spans(text: str | None, dateline: str | None = None, noise: str | None = None, most: int = 8) -> list[tuple[int, int]]:
    """Spans [start, end) of the first sentences after the headline (the first line that isn't empty).

    Sentences have 60 to 320 characters (from 20 on with Chinese or Japanese) and end as sentences do. What stands glued
    before one, and what ``dateline`` matches at its beginning, is left out, so the span still is what the text says;
    sentences that ``noise`` matches at their beginning don't count. Null and empty patterns match nothing. The text is
    read until ``most`` are found.
    """
    out: list[tuple[int, int]] = []
    lines = re.finditer("[^\n]+", text or "")
    next(lines, None)
    for line in lines:
        start = line.start()
        for end, following in chain(((m.start(), m.end()) for m in _END.finditer(line[0])), [(len(line[0]),) * 2]):
            stop = line.start() + end
            s = text[start:stop].lstrip()
            s = s[glued_place(s) :]
            if dateline and (m := _pattern(dateline).match(s)):
                s = s[m.end() :]
            start = line.start() + following
            if (20 if _CJK.search(s) else 60) <= len(s) <= 320 and s[-1] in _CLOSED and not (noise and _pattern(noise).match(s)):
                out.append((stop - len(s), stop))
                if len(out) == most:
                    return out
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])))
def spans(s: pd.Series, dateline: pd.Series, noise: pd.Series) -> pd.Series:
    rows = zip(s, dateline, noise)
    return pd.Series([[{"char_start": a, "char_end": b} for a, b in sentence_spans(*row)] for row in rows], dtype=object)


def sentences(articles: DataFrame, desks: DataFrame | None = None) -> DataFrame:
    """(id, ord, char_start, char_end, sentence) of articles (id, text[, country]).

    ``desks`` (country, dateline, noise) tells what each country's outlets put before sentences, and what isn't one.
    """
    if desks is None:
        rows = articles.select("id", "text", F.lit(None).cast("string").alias("dateline"), F.lit(None).cast("string").alias("noise"))
    else:
        rows = articles.select("id", "text", "country").join(small(desks.select("country", "dateline", "noise")), "country", "left")
    flat = rows.select("id", "text", F.posexplode(spans("text", "dateline", "noise")).alias("ord", "s"))
    return flat.select("id", "ord", "s.char_start", "s.char_end", F.expr("substring(text, s.char_start + 1, s.char_end - s.char_start)").alias("sentence"))


def told_by(members: DataFrame) -> DataFrame:
    """The articles that a story may be quoted from: of its core, with a text, no copies. An unknown similarity is the core's."""
    return members.where((F.coalesce("similarity", F.lit(1.0)) >= 0.93) & F.col("text").isNotNull() & F.col("syndicated_of").isNull())


def scored(candidates: DataFrame, members: DataFrame) -> DataFrame:
    """``candidates`` (story_id, id, sentence, vector) of articles that may be quoted, with score: nearness to the mean of
    the story's such articles (``members``: story_id, id, vector, similarity, text, syndicated_of), and a little for a quotation."""
    told = told_by(members)
    centres = vectors.mean_vectors(told, ["story_id"], "vector", "__c").withColumn("__c", vectors.unit("__c"))
    rows = candidates.join(told.select("story_id", "id").distinct(), ["story_id", "id"], "left_semi").join(centres, "story_id")
    cue = F.when(patterns.matches(F.col("sentence"), fixed.QUOTE_CUES), CUE).otherwise(0.0)
    return rows.withColumn("score", vectors.dot("vector", "__c") + cue).drop("__c")


def choose(candidates: DataFrame, most: int = 3) -> DataFrame:
    """Per story up to ``most`` sentences: the best of each source, then the best of each scope, then the rest by score."""
    by_source = Window.partitionBy("story_id", "source_id").orderBy(F.desc("score"), "id", "ord")
    best = candidates.withColumn("__s", F.row_number().over(by_source)).where("__s = 1")
    by_scope = Window.partitionBy("story_id", "scope").orderBy(F.desc("score"), "id")
    best = best.withColumn("__o", F.row_number().over(by_scope))
    place = Window.partitionBy("story_id").orderBy((F.col("__o") > 1).cast("int"), F.desc("score"), "id")
    return best.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).drop("__s", "__o")


def verify(excerpts: DataFrame, articles: DataFrame) -> DataFrame:
    """``excerpts`` (article_id, text, char_start, char_end) with ok: the text stands there, character by character."""
    a = articles.select(F.col("id").alias("article_id"), F.col("text").alias("__t"))
    there = F.expr("substring(__t, char_start + 1, char_end - char_start)")
    return excerpts.join(a, "article_id", "left").withColumn("ok", F.coalesce(there == F.col("text"), F.lit(False))).drop("__t")
