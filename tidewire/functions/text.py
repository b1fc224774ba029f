"""Text, address and date functions as column expressions.

Word characters are letters, digits and the underscore of any script, spelled out as classes: ``\\w`` means different
things in different engines. What no built-in can express (Unicode normalisation, entity decoding) is a pandas UDF.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query parameters that only track.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_eid", "_ga", "_gl",
    "ref", "ref_src", "vn_source", "vn_campaign", "vn_medium", "session_id", "at_custom1", "at_custom2",
]
#: First and last code points (hexadecimal) of symbols that are taken out.
EMOJI = [
    ("1F1E6", "1F1FF"), ("1F300", "1F5FF"), ("1F600", "1F64F"), ("1F680", "1F6FF"), ("1F700", "1F77F"), ("1F780", "1F7FF"),
    ("1F800", "1F8FF"), ("1F900", "1F9FF"), ("1FA00", "1FA6F"), ("1FA70", "1FAFF"), ("2600", "26FF"), ("2700", "27BF"),
    ("FE0E", "FE0F"), ("200D", "200D"),
]
EMOJI_CLASS = "[" + "".join(rf"\x{{{a}}}-\x{{{b}}}" for a, b in EMOJI) + "]+"
WORD = r"[\p{L}\p{N}_]"
#: Words too common in event headlines to tell events apart.
STOP_TOKENS = (
    "attack attacks strike strikes clash clashes killed kills kill killing dead death over after with from into amid says said report "
    "reports news more than least three four five against under near"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed normal form; null gives the empty text."""
    return s.fillna("").map(lambda t: unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def decoded(s: pd.Series) -> pd.Series:
    """Entities decoded twice, then compatibility forms resolved; null gives the empty text."""
    return s.fillna("").map(lambda t: unicodedata.normalize("NFKC", html.unescape(html.unescape(t))))


@F.pandas_udf(T.StringType())
def fold(s: pd.Series) -> pd.Series:
    """Lower case without accents, for search; strokes of d, l and the dotless i go too."""
    gone, plain = re.compile("[̀-ͯ]"), str.maketrans("đłı", "dli")
    return s.fillna("").map(lambda t: gone.sub("", unicodedata.normalize("NFD", t.lower())).translate(plain))


def strip_emoji(c: Column | str) -> Column:
    return F.coalesce(F.regexp_replace(_c(c), EMOJI_CLASS, ""), F.lit(""))


def squash(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(c), r"\s+", " "))


def clean(c: Column | str) -> Column:
    """Readable text of a feed item: entities, styled letters, symbols, tags and white space resolved."""
    return squash(nfc(F.regexp_replace(strip_emoji(decoded(_c(c))), "<[^>]+>", " ")))


def url_part(c: Column | str, part: str) -> Column:
    """A part of an address by pattern: scheme, host, path, query; empty where there is none."""
    pattern = {"scheme": r"^([^:/?#]+)://", "host": r"^[^:/?#]+://([^/?#]*)", "path": r"^[^:/?#]+://[^/?#]*([^?#]*)", "query": r"^[^?#]*\?([^#]*)"}
    return F.regexp_extract(_c(c), pattern[part], 1)


def clean_url(c: Column | str) -> Column:
    """Canonical address: lower scheme and host, single slashes, no tracking parameters, no fragment."""
    u = F.trim(_c(c))
    kept = F.filter(F.split(url_part(u, "query"), "&"), lambda q: (q != "") & ~F.lower(F.split_part(q, F.lit("="), F.lit(1))).isin(TRACKING))
    query = F.array_join(kept, "&")
    base = F.concat(F.lower(url_part(u, "scheme")), F.lit("://"), F.lower(url_part(u, "host")), F.regexp_replace(url_part(u, "path"), "/+", "/"))
    whole = F.concat(base, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(u.isNull(), "").when((url_part(u, "scheme") == "") | (url_part(u, "host") == ""), u).otherwise(whole)


def domain(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(url_part(c, "host")), r"^www\.", "")


def url_section(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_c(c), r"https?://[^/]+/([^/?#]+)", 1))


def url_sections(c: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url_part(c, "path")), "/"), lambda x: x != ""))


def title_key(c: Column | str) -> Column:
    """Letters and digits of a title, lower case; what is left tells whether two titles are the same."""
    return F.regexp_replace(F.lower(_c(c)), r"[^\p{L}\p{N}]+", "")


def norm_key(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.lower(_c(c)), r"[^a-z0-9\x{00C0}-\x{024F}\x{0400}-\x{04FF}\x{1E00}-\x{1EFF}]+", ""), 1, 64)


def without_outlet(title: Column | str, outlet: Column | str) -> Column:
    """The title without a trailing " - Outlet" of 2 to 60 characters, if it ends with the outlet's name."""
    t, o = _c(title), _c(outlet)
    return F.when(F.endswith(t, o), F.regexp_replace(t, r"\s+[-–—|]\s+[^-–—|]{2,60}$", "")).otherwise(t)


def clip(c: Column | str, limit: int = 260) -> Column:
    """At most ``limit`` characters, cut at a word, with an ellipsis."""
    cut = F.regexp_replace(F.regexp_replace(F.substring(_c(c), 1, limit), r"\s\S*$", ""), r"[ ,.;:]+$", "")
    return F.when(F.length(_c(c)) <= limit, _c(c)).otherwise(F.concat(cut, F.lit("…")))


def traffic(c: Column | str) -> Column:
    """'2K+' as 2000, '1.5M' as 1500000, otherwise the digits; 0 without any."""
    number = F.coalesce(F.try_to_number(F.regexp_replace(F.regexp_extract(_c(c), r"([\d.,]+)", 1), ",", ""), F.lit("999999999D99")).cast("double"), F.lit(0.0))
    unit = F.upper(F.regexp_extract(_c(c), r"[\d.,]+\s*([KkMm])", 1))
    return (number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)).cast("long")


def significant_tokens(c: Column | str) -> Column:
    """Distinct words of four or more letters or digits that tell an event, without plural s."""
    words = F.filter(F.regexp_extract_all(F.lower(_c(c)), F.lit("[a-z0-9]{4,}"), F.lit(0)), lambda w: ~w.isin(STOP_TOKENS))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.regexp_replace(w, "s+$", "")), lambda w: F.length(w) >= 3))


def words(c: Column | str) -> Column:
    """Lower-case words; words of Chinese or Japanese characters come as their character pairs."""
    cjk = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"
    tokens = F.regexp_extract_all(F.lower(_c(c)), F.lit(f"{WORD}+"), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))
    return F.flatten(F.transform(tokens, lambda w: F.when(w.rlike(cjk) & (F.length(w) > 1), pairs(w)).otherwise(F.array(w))))


def article_text(title: Column | str, lead: Column | str) -> Column:
    return F.concat(F.lit("passage: "), F.substring(F.concat(_c(title), F.lit(". "), F.coalesce(_c(lead), F.lit(""))), 1, 800))


def content(text: Column | str, title: Column | str, lead: Column | str) -> Column:
    """The text, or title and lead where the text is missing or empty."""
    return F.coalesce(F.nullif(_c(text), F.lit("")), F.concat(_c(title), F.lit(" "), F.coalesce(_c(lead), F.lit(""))))


def content_hash(text: Column | str, title: Column | str, lead: Column | str) -> Column:
    return F.sha2(content(text, title, lead), 256)


def calibrate(c: Column | str) -> Column:
    """Raw cosine to the 0..1 scale that readers see: linear between fixed knots, clamped outside."""
    x, knots = _c(c), [(0.78, 0.0), (0.86, 0.75), (0.895, 0.85), (0.925, 0.93), (1.0, 1.0)]
    out = F.when(x <= knots[0][0], F.lit(knots[0][1]))
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        out = out.when(x <= b, F.lit(u) + (x - a) * ((v - u) / (b - a)))
    return out.otherwise(F.lit(1.0))


def parse_when(c: Column | str) -> Column:
    """Times of feeds in their usual spellings as UTC; null where none fits."""
    s = F.trim(_c(c))
    day = F.regexp_replace(s, r"^[A-Za-z]+,\s*", "")
    tries = [F.try_to_timestamp(day, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "d MMM yyyy", "MMMM d, yyyy - HH:mm")]
    local = F.to_utc_timestamp(F.try_to_timestamp(s, F.lit("M/d/yyyy h:mm:ss a")), "+07:00")
    return F.coalesce(local, *tries, F.try_to_timestamp(s))


def trend(last_day: Column | str, articles: Column | str) -> Column:
    share = _c(last_day) / _c(articles)
    return F.when(_c(last_day) == _c(articles), "New").when(share >= 0.4, "Growing").when(_c(last_day) == 0, "Quiet").otherwise("")
