"""Filter interaction audit: what each filter of a chain removes in every order the filters could have.

Rows become five failure flags and a part. Counts by all flags and part are a small table; its CUBE holds, in the
grouping-set rows whose selected flags are all false, how many rows survive each subset of the filters. An order of the
filters is a path through subsets, so what a step removes is the difference of two survivors: the table is joined with
itself over the pairs of subsets of each step. No order ever runs over the rows again.

Rows with one text are told by a SHA-256 digest. A hot text is folded into one row a part before it is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, few, slices

#: The filters' letters, in the order of the flags.
FILTERS = "ABCDE"
#: Orders are the factorial of the filters; beyond this many filters there would be too many.
MOST_FILTERS = 7

_CAPITALS = bytes(range(65, 91))
_SYMBOL = re.compile(rb"[#$%&*|]").search


def text_failures(text: str) -> tuple[bool, bool, bool, bool]:
    """Whether the text fails the filters on its length, its distinct words, its capitals and its symbols."""
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII spaces only
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), bool(_SYMBOL(raw))


def flag_counts(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """n, good, toxic by part and the flags A to E (true: fails), over all rows.

    A null text is the empty one, a null part the empty string. E holds for a row whose text some row of a smaller key
    has; a null key is neither smaller nor larger than another, so E never holds for its row and never because of it.
    Repeated rows count each, and are no duplicates of each other: their key is the same. A key is good or toxic if any
    of its ``labels`` (key, quality, toxic) says 1. No rows give no counts.
    """
    flags = list(FILTERS[:4])

    def measure(batches):
        for b in slices(batches):
            texts = [t or "" for t in b.column("__text").to_pylist()]
            found = list(zip(*map(text_failures, texts))) if texts else [()] * 4
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__part"), *(pa.array(f, pa.bool_()) for f in found), digests], ["id", "part", *flags, "digest"])

    rows = df.select(F.col(key).cast("long").alias("__id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("__part"), F.col(text).alias("__text"))
    rows = rows.mapInArrow(measure, "id long, part string, A boolean, B boolean, C boolean, D boolean, digest binary")
    rows = rows.groupBy("digest", "id", "part", *flags).agg(F.count("*").alias("n"))
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id"))
    marks = few(marks.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    is_set = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = rows.join(marks, "id", "left").select("digest", "id", "part", *flags, is_set("good"), is_set("toxic"), "n")
    # One row a text, part and label: how many rows, how many of them have the smallest key, how many have none.
    texts = rows.groupBy("digest", "part", "good", "toxic", *flags).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("at_least"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("loose"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("alone", F.col("loose") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0))
    split = F.explode(F.array(F.struct(F.lit(False).alias("E"), F.col("alone").alias("n")), F.struct(F.lit(True).alias("E"), (F.col("n") - F.col("alone")).alias("n"))))
    texts = texts.select("part", "good", "toxic", *flags, split.alias("x")).select("part", "good", "toxic", *flags, "x.E", "x.n").where("n > 0")
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return texts.groupBy("part", *FILTERS).agg(count("good"), count("toxic"), F.sum("n").alias("n"))


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, subset, n, good, toxic: the rows that fail no filter of the subset, for every subset and part.

    ``subset`` is a bit mask, the first filter its lowest bit; subsets that nothing survives have zeros. A part of null
    is the whole table.
    """
    grouped = lambda f: F.lit(1) - F.grouping(f)
    subset = sum((F.shiftleft(grouped(f).cast("int"), k) for k, f in enumerate(filters)), F.lit(0))
    cube = counts.cube("part", *filters).agg(subset.alias("subset"), F.grouping("part").alias("whole"), *(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    passed = [F.coalesce(~F.col(f), F.lit(True)) for f in filters]  # a flag that is not selected is null
    cube = cube.where(sum((p.cast("int") for p in passed), F.lit(0)) == len(filters)).select("part", "subset", "n", "good", "toxic")
    every = counts.select("part").distinct().unionByName(counts.select(F.lit(None).cast("string").alias("part")).limit(1))
    every = every.select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("subset"))
    same = every["part"].eqNullSafe(cube["part"]) & (every["subset"] == cube["subset"])
    return every.join(cube, same, "left").select(every["part"], every["subset"], *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "good", "toxic")))


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """filter_order, step, filter and the subsets before and after the step, for all orders of the filters."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    bit = {f: 1 << k for k, f in enumerate(filters)}
    rows = []
    for order in permutations(filters):
        before = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(order), step, f, before, before | bit[f]))
            before |= bit[f]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order and step, from ``flag_counts``: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley (its filter's removed rows, summed over all orders)."""
    s = cut(survivors(counts, filters).where(F.col("part").isNotNull()))
    steps = F.broadcast(orders(counts.sparkSession, filters))  # a row a step of an order: MOST_FILTERS bounds it
    was = s.select("part", F.col("subset").alias("before"), F.col("n").alias("n0"), F.col("good").alias("g0"), F.col("toxic").alias("t0"))
    now = s.select("part", F.col("subset").alias("after"), F.col("n").alias("kept"), F.col("good").alias("g1"), F.col("toxic").alias("t1"))
    pairs = was.join(steps, "before").join(now, ["part", "after"])
    full = (1 << len(filters)) - 1
    at = lambda mask: F.sum(F.when(F.col("subset") == mask, F.col("n")).otherwise(0))
    by_filter = [F.struct(F.lit(f).alias("filter"), (at(0) - at(1 << k)).alias("fails"), (at(full & ~(1 << k)) - at(full)).alias("unique_fails")) for k, f in enumerate(filters)]
    alone = s.groupBy("part").agg(F.array(*by_filter).alias("x")).select("part", F.explode("x").alias("x")).select("part", "x.*")
    removed = F.col("n0") - F.col("kept")
    steps_of = pairs.join(alone, ["part", "filter"]).withColumn("removed", removed)
    return steps_of.select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        (F.col("g0") - F.col("g1")).alias("good_lost"), (F.col("t0") - F.col("t1")).alias("toxic_lost"),
        F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"),
    )
