"""Many terms found in one pass over each text: an automaton over all of them, word limits checked where it hits."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import _UNSPACED_PY

#: Terms and their characters in all that one automaton holds; more terms take further passes over the texts.
MOST_TERMS, MOST_CHARS = 200_000, 8_000_000

_automata: dict[str, object] = {}


def _automaton(name: str, terms: dict[str, list]):
    """The automaton of these terms, once a worker process."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        a = ahocorasick.Automaton()
        for term, numbers in terms.items():
            a.add_word(term, (len(term), bool(_UNSPACED_PY.search(term)), numbers))
        a.make_automaton()
        _automata[name] = a
    return _automata[name]


def _open(text: str, at: int, before: bool) -> bool:
    """Whether a word may end at this character, or begin after it: it is none of a word, or of a script without spaces."""
    if not 0 <= at < len(text):
        return True
    c = text[at]
    return not (c.isalnum() or c == "_") or bool(_UNSPACED_PY.match(c))


def hits(text: str, automaton) -> set:
    """Numbers of the terms that a text has, letter case ignored: whole words, but anywhere for terms of unspaced scripts."""
    low, found = text.lower(), set()
    for end, (size, anywhere, numbers) in automaton.iter(low):
        if anywhere or _open(low, end + 1, False) and _open(low, end - size, True):
            found.update(numbers)
    return found


def _portions(terms: DataFrame) -> list[DataFrame]:
    """``terms`` in portions that one automaton holds: by count and size, each term in one portion."""
    n, size = terms.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    parts = max(1, -(-n // MOST_TERMS), -(-size // MOST_CHARS))
    if parts == 1:
        return [terms] if n else []
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(2 * parts)) == k) for k in range(2 * parts)]


def found_terms(texts: DataFrame, terms: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, number) once for each row of ``terms`` (number, term) that a row's text has.

    Null texts have none; null and empty terms are in none. Texts never leave their partition: a worker goes over each
    once, whatever the number of terms. Catalogs beyond ``MOST_TERMS`` or ``MOST_CHARS`` take a pass a portion.
    """
    kinds = texts.schema[key].dataType.simpleString()
    terms = terms.where(F.length(F.trim("term")) > 0).select(F.col("number").cast("long").alias("number"), F.lower("term").alias("term"))
    out = None
    for portion in _portions(terms):
        held: dict[str, list] = {}
        for r in portion.collect():  # bounded by the portion
            held.setdefault(r.term, []).append(r.number)
        shared, name = texts.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex

        def scan(batches, shared=shared, name=name):
            automaton = _automaton(name, shared.value) if shared.value else None
            for b in batches:
                per = [sorted(hits(t, automaton)) if t and automaton else [] for t in b.column("__text").to_pylist()]
                at = pa.array([k for k, x in enumerate(per) for _ in x], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("__key").take(at), pa.array([n for x in per for n in x], pa.int64())], [key, "number"])

        part = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(scan, f"{key} {kinds}, number long")
        out = part if out is None else out.unionByName(part)
    return texts.sparkSession.createDataFrame([], f"{key} {kinds}, number long") if out is None else out
