"""Reprints: texts that share enough sampled shingles with an earlier text of another source in the same country."""

from __future__ import annotations

import re
from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fixed_values as fixed
from ..functions import patterns, text
from .graph import cut


_WORDS = re.compile(r"\w+").findall
_PAIRED = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff]").search


def content_words(content: str) -> list[str]:
    """Lower-case words as ``text.words`` has them; those with Chinese or Japanese characters as their character pairs."""
    found = _WORDS(content.lower())
    if not _PAIRED(content):
        return found
    return [x for w in found for x in ([w[k : k + 2] for k in range(len(w) - 1)] if len(w) > 1 and _PAIRED(w) else [w])]


def shingle_hashes(words: list[str], width: int = 8) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words: the first 64 bits of the md5, of which one in four is kept (those
    that are divisible by 4). Runs are slices of the words written once."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    raw = [w.encode() for w in words]
    whole, ends = b" ".join(raw), list(accumulate(len(w) + 1 for w in raw))
    starts = [0, *ends]
    h = np.frombuffer(b"".join([md5(whole[starts[k] : ends[k + width - 1] - 1]).digest()[:8] for k in range(len(words) - width + 1)]), ">i8").astype(np.int64)
    return np.unique(h[h & 3 == 0])


def _portions(batches, rows: int = 64):
    """Batches in portions of a few rows: only their texts and hashes are objects of Python's at a time, however many a batch has."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` (with ``content``) with ``hashes`` in its place."""
    names = [c for c in df.columns if c != "content"]

    def run(batches):
        for b in _portions(batches):
            lists = [shingle_hashes(content_words(c or "")) for c in b.column("content").to_pylist()]
            offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.ListArray.from_arrays(pa.array(offsets), flat)], [*names, "hashes"])

    return df.mapInArrow(run, df.drop("content").schema.add("hashes", T.ArrayType(T.LongType())))


def _spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores at least; a small input comes as one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if df.rdd.getNumPartitions() < cores else df


def reprints(articles: DataFrame, least: int = 5, share: float = 0.6, wire_share: float = 0.35) -> DataFrame:
    """(id, syndicated_of, votes, n_hashes) of each article that reprints an earlier one.

    ``articles``: id, country, source_id, ord (time order), content, wire (the source is a wire or state outlet).
    Articles of a country with the same hashes are one class, and only classes meet: however often a text is reprinted,
    it is one row there. Of a class an article takes the earliest member of another source: the class's first, or the
    first that isn't of that one's source. The best class has most votes, then the earliest.

    A class whose hashes another has to a share s has one of its n - ceil(s n) + 1 rarest hashes in common with it, so
    only these are looked up (with s the smaller of the two shares). Hashes of one class alone come first among the
    rarest: a text of which too little occurs elsewhere is not looked up at all, nor is boilerplate that many texts
    share, unless it is most of a text. The votes of pairs found so are counted over all hashes.
    """
    rows = _spread(articles).select("id", "country", "source_id", "ord", "wire", patterns.matches(F.col("content"), fixed.WIRE_CREDITS).alias("credit"), "content")
    rows = cut(_hashed(rows).where(F.size("hashes") >= least).withColumn("class", F.xxhash64("country", "hashes")))
    member = F.struct("ord", "id", "source_id", "wire")
    classes = cut(rows.groupBy("country", "class").agg(F.min(member).alias("first"), F.max("ord").alias("last"), F.any_value("hashes").alias("hashes")))
    rows = rows.drop("hashes").join(classes.select("class", "first", F.size("hashes").alias("n_hashes")), "class")
    others = rows.where(F.col("source_id") != F.col("first.source_id")).groupBy("class").agg(F.min(member).alias("other"))
    flat = classes.select("country", "class", F.size("hashes").alias("n"), "last", F.col("first.ord").alias("start"), F.explode("hashes").alias("h"))
    common = flat.groupBy("country", "h").agg(F.count("*").alias("held")).where("held > 1")
    flat = cut(flat.join(common, ["country", "h"]))
    rare = Window.partitionBy("class").orderBy("held", "h")
    shared = F.count("*").over(Window.partitionBy("class"))
    room = F.col("n") - F.ceil(F.col("n") * min(share, wire_share) - 1e-9) + 1 - (F.col("n") - shared)  # of the rarest, those that others have
    asked = flat.withColumn("room", room).withColumn("place", F.row_number().over(rare)).where(F.col("place") <= F.col("room"))
    of = flat.select("country", "h", F.col("class").alias("of"), F.col("start").alias("of_start"))
    pairs = asked.select("country", "h", "class", "last").join(of, ["country", "h"]).where((F.col("of_start") < F.col("last")) & (F.col("of") != F.col("class"))).select("class", "of").distinct()
    own, theirs = classes.select("class", F.col("hashes").alias("a")), classes.select(F.col("class").alias("of"), F.col("hashes").alias("b"))
    votes = pairs.join(own, "class").join(theirs, "of").select("class", "of", F.size(F.array_intersect("a", "b")).cast("long").alias("votes"))
    itself = classes.where(F.col("first.ord") < F.col("last")).select("class", F.col("class").alias("of"), F.size("hashes").cast("long").alias("votes"))
    votes = votes.unionByName(itself)
    held = classes.select(F.col("class").alias("of"), F.col("first").alias("of_first")).join(others.select(F.col("class").alias("of"), "other"), "of", "left")
    met = rows.select("id", "source_id", "ord", "credit", "n_hashes", "class").join(votes, "class").join(held, "of")
    met = met.withColumn("a", F.when(F.col("of_first.source_id") != F.col("source_id"), F.col("of_first")).otherwise(F.col("other")))
    met = met.where(F.col("a.ord") < F.col("ord"))
    best = met.groupBy("id").agg(F.max_by(F.struct("a", "votes", "credit", "n_hashes"), F.struct("votes", -F.col("a.ord"))).alias("b"))
    need = F.when(F.col("b.a.wire") | F.col("b.credit"), wire_share).otherwise(share)
    best = best.where(F.col("b.votes") / F.col("b.n_hashes") >= need)
    return best.select("id", F.col("b.a.id").alias("syndicated_of"), F.col("b.votes").alias("votes"), F.col("b.n_hashes").cast("long").alias("n_hashes"))


def same_titles(articles: DataFrame) -> DataFrame:
    """(id, syndicated_of): headline-only articles whose title an earlier article of another source has already."""
    w = Window.partitionBy("country", "key").orderBy("ord", "id")
    rows = articles.withColumn("key", text.title_key("title")).where("key <> ''").withColumn("first", F.first(F.struct("id", "source_id")).over(w))
    hit = (F.col("first.id") != F.col("id")) & (F.col("first.source_id") != F.col("source_id"))
    return rows.where(hit).select("id", F.col("first.id").alias("syndicated_of"))
