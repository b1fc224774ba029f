"""Patterns of the news rules as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

UNSPACED = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{0E00}-\x{0E7F}\x{1780}-\x{17FF}\x{0E80}-\x{0EFF}]"
_UNSPACED_PY = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯฀-๿ក-៿຀-໿]")
LEFT = rf"(?:(?<![\p{{L}}\p{{N}}_])|(?<={UNSPACED}))"
RIGHT = rf"(?:(?![\p{{L}}\p{{N}}_])|(?={UNSPACED}))"

def term_regex(term: str) -> str:
    """A term as a pattern: inside words for scripts without spaces, at word boundaries otherwise."""
    body = re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", term)
    return body if _UNSPACED_PY.search(term) else LEFT + body + RIGHT


def any_term(terms: list[str]) -> str:
    """One pattern for many terms, letter case of all scripts ignored."""
    return "(?iu)" + "|".join(f"(?:{term_regex(t)})" for t in terms)


def keyword_regex(keywords: list[str]) -> str:
    """Up to seven letters whole words; longer ones match from a word's beginning, so inflections count."""
    quote = lambda t: re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", t)
    parts = [quote(k) if _UNSPACED_PY.search(k) else LEFT + quote(k) + (RIGHT if len(k) <= 7 else "") for k in keywords]
    return "|".join(f"(?:{p})" for p in parts)


def matches(c: Column, pattern: str) -> Column:
    """Whether a pattern of the fixed values is found, letter case and word limits of all scripts; null counts as empty."""
    return F.coalesce(c.rlike("(?iuU)" + pattern), F.lit(False))


def sports_spam(title: Column, outlet: Column | None = None, url: Column | None = None) -> Column:
    """Broadcast and betting spam: by headline, by an outlet of sports, or by an outlet or address whose broadcasts are."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t, o, u = F.trim(F.coalesce(title, F.lit(""))), low(outlet if outlet is not None else F.lit("")), low(url if url is not None else F.lit(""))
    by_title = reduce(or_, (matches(t, p) for p in (fixed.SPAM_DELIMITERS, fixed.SPAM_STREAMS, fixed.SPAM_LEAGUES, fixed.SPAM_MATCHES)))
    by_host = reduce(or_, (F.contains(x, F.lit(h)) for h in fixed.SPAM_HOSTS for x in (o, u))) & matches(t, fixed.SPAM_HOST_WORDS)
    return o.isin(fixed.SPORTS_OUTLETS) | ((t != "") & (by_title | by_host))


def first_label(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern the text has; null if none."""
    return F.coalesce(*(F.when(matches(text, pattern), label) for label, pattern in rules))


def word_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Rules of labels and words, as ``first_label`` takes them."""
    return [(label, any_term(words.split())) for label, words in rules]


def _no_event(themes: Column) -> Column:
    low = F.lower(F.concat_ws(" ", themes))
    return F.contains(low, F.lit("sport")) | F.contains(low, F.lit("culture"))


def disaster_label(text: Column, themes: Column | None = None) -> Column:
    """The kind of disaster that a story's titles tell of; none for sport and culture."""
    label = first_label(text, fixed.DISASTERS)
    return label if themes is None else F.when(~_no_event(themes), label)


def violence_label(text: Column, themes: Column | None = None) -> Column:
    """The kind of violence, if no word speaks of arts or sport; else what the story's themes say."""
    label = first_label(text, fixed.VIOLENCE)
    if themes is None:
        return F.when(~matches(text, fixed.NOT_VIOLENCE), label)
    low = F.lower(F.concat_ws(" ", themes))
    said = reduce(or_, (F.contains(low, F.lit(t)) for t in fixed.VIOLENT_THEMES))
    return F.when(~_no_event(themes) & ~matches(text, fixed.NOT_VIOLENCE), F.coalesce(label, F.when(said, "Armed Clash & Strike")))


def is_election(themes: Column) -> Column:
    low = F.lower(F.concat_ws(" ", themes))
    return F.exists(F.array(*map(F.lit, fixed.ELECTION_TERMS)), lambda t: F.contains(low, t))
