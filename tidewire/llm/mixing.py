"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by hash, and blocks are drawn in a hashed permutation, pass after pass over the
source, until its target of words is met: whole blocks by quota, the last block document by document. A splitting tree
then deals each source's quota of blocks to the output shards: every node splits its shards in two and draws how many
blocks of each source go left from the multivariate hypergeometric distribution. Each block finds its shard by going
down the tree with seeded draws, so shards get disjoint runs of each source's permutation and no two tasks ever have to
agree on anything but the quotas, a number per source. Shards are shuffled locally, by hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, few, whole_row

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Documents in a block, about; blocks of a source's permutation that are numbered together, about.
BLOCK_DOCS, RANGE_BLOCKS = 128, 4096
#: Words of an output shard, about: what one task writes.
SHARD_WORDS = 3_000_000
#: Nodes of the splitting tree that a task remembers.
MOST_NODES = 4096


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size, n) with target: ``share`` of all sizes by weight, ``most`` sizes at most.

    Sources that reach their limit leave their excess to the others by weight. Sorted by limit per weight, those that
    reach it come first, and the level of the rest is what remains over the remaining weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    s = sources.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(most))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(every) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    final = F.min(F.when(F.col("limit") / F.col("weight") > F.col("level"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level"))))
    s = s.withColumn("final", final.over(every)["level"])
    target = F.least("limit", F.coalesce(F.col("final") * F.col("weight"), F.col("limit")))
    return s.select("source", "source_size", "n", target.alias("target"))


class SplittingTree:
    """Which shard a block goes to, found by going down the tree.

    A node deals its quotas (blocks of each source) to the shards ``low`` to ``high``: the left half gets its share of
    all blocks, made up of sources by one draw from the multivariate hypergeometric distribution. The draw follows from
    the seed and the node, so every task that passes a node sees the same; no table of shards is ever made.
    """

    def __init__(self, quotas: np.ndarray, shards: int, seed: int):
        self.quotas, self.shards, self.seed = quotas.astype(np.int64), shards, seed
        self.nodes: dict[int, np.ndarray] = {}

    def left(self, node: int, q: np.ndarray, low: int, middle: int, high: int) -> np.ndarray:
        """Blocks of each source that go left."""
        out = self.nodes.get(node)
        if out is None:
            rng, total = np.random.default_rng([self.seed, node]), int(q.sum())
            take, out = total * (middle - low) // (high - low), np.zeros_like(q)
            for k in np.flatnonzero(q).tolist():  # one colour after the other, given what is still to draw
                out[k] = _drawn(rng, int(q[k]), total - int(q[k]), take)
                take, total = take - int(out[k]), total - int(q[k])
            if len(self.nodes) >= MOST_NODES:
                self.nodes.clear()
            self.nodes[node] = out
        return out

    def shards_of(self, source: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The shard of each block copy, given its source's number and its place among the source's copies."""
        out = np.zeros(len(source), np.int64)
        stack = [(1, 0, self.shards, self.quotas, np.arange(len(source)), index.astype(np.int64))]
        while stack:
            node, low, high, q, rows, at = stack.pop()
            if high - low == 1:
                out[rows] = low
                continue
            middle = (low + high) // 2
            part = self.left(node, q, low, middle, high)
            near = at < part[source[rows]]
            if near.any():
                stack.append((2 * node, low, middle, part, rows[near], at[near]))
            if not near.all():
                far = ~near
                stack.append((2 * node + 1, middle, high, q - part, rows[far], at[far] - part[source[rows[far]]]))
        return out


#: Blocks that the tree deals at most, all copies together: what the library draws from. Beyond that blocks grow.
MOST_BLOCKS = 10**9 - 1


def _drawn(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` draws without replacement are good ones."""
    return int(rng.hypergeometric(good, bad, take)) if good and take else 0


def plan_mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, shards: int | None = None) -> DataFrame:
    """Per row of ``df``: id, source, size, source_size, target, taken and shards.

    size is the text's number of words (null: 0), taken the words that the mix takes of the row, repeats counted:
    whole copies, and of one document per source a part, so that a source's taken words are its target rounded to a
    whole number. ``shards`` has the output shard of each copy. Everything follows from keys, sources, sizes and the
    seed, so reruns agree; null keys and sources are values like others, repeated rows are rows like others. Without
    ``shards`` there are as many as hold about ``SHARD_WORDS`` words each.
    """
    return _plan(df, key, text, source, seed, shards)[0]


def _plan(df: DataFrame, key: str, text: str, source: str, seed: int, shards: int | None) -> tuple[DataFrame, int]:
    """``plan_mix`` and its number of shards."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = df.select(F.col(key).alias("id"), F.col(source).alias("source"), size.alias("size"))
    rows = cut(rows.withColumn("hash", F.xxhash64(F.lit(seed), F.col("id").cast("string"))))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    # Two copies of each document at most; four leave room for each source's last block.
    docs_of_block = F.greatest(F.lit(BLOCK_DOCS), F.ceil(F.sum("n").over(Window.partitionBy()) * 4 / F.lit(MOST_BLOCKS)))  # a row a source
    sources = sources.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / docs_of_block)).cast("long"))
    words = F.round("target").cast("long")
    sources = sources.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long"))
    sources = cut(sources.withColumn("rest", words - F.col("passes") * F.col("source_size")))
    n_sources, n_words = sources.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    shards = shards or max(16, -(-int(n_words) // SHARD_WORDS))
    dim = few(sources.drop("n").withColumnRenamed("source", "src"))
    on = F.col("source").eqNullSafe(F.col("src"))
    part = lambda h, n: F.shiftright(F.shiftrightunsigned(h, 32) * n, 32)
    dealt = rows.join(dim, on).select("id", "source", "size", "hash", "source_size", "target", "passes", "rest", "n_blocks", part(F.col("hash"), F.col("n_blocks")).alias("block"))
    blocks = dealt.groupBy("source", "block", "passes", "rest", "n_blocks").agg(F.sum("size").alias("words"))
    # A source's permutation of blocks goes by hash, range by range: neither a window nor a task holds a whole source.
    blocks = blocks.withColumn("place", F.xxhash64(F.lit(seed + 1), "source", "block"))
    blocks = cut(blocks.withColumn("range", part(F.col("place"), F.ceil(F.col("n_blocks") / RANGE_BLOCKS))).drop("n_blocks"))
    ranges = blocks.groupBy("source", "range").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(ahead), F.lit(0))
    ranges = ranges.select(F.col("source").alias("src"), F.col("range").alias("at"), start("words").alias("words_ahead"), start("n").alias("n_ahead"))
    inside = Window.partitionBy("source", "range").orderBy("place", "block")
    up_to = F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("turn", F.row_number().over(inside) - 1).withColumn("before", up_to - F.col("words"))
    blocks = blocks.join(few(cut(ranges)), on & (F.col("range") == F.col("at")))
    blocks = cut(blocks.select("source", "block", "passes", "rest", "words", (F.col("turn") + F.col("n_ahead")).alias("turn"), (F.col("before") + F.col("words_ahead")).alias("before")))
    quota = blocks.groupBy("source").agg((F.max("passes") * F.count("*") + F.count_if(F.col("before") < F.col("rest"))).alias("quota"), F.count("*").alias("in_pass"))
    numbered = cut(quota.withColumn("number", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1))
    quotas = np.array([r.quota for r in numbered.orderBy("number").select("quota").collect()], np.int64)  # a number a source
    taken = F.col("passes") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)
    blocks = blocks.join(few(numbered.select(F.col("source").alias("src"), "number", "in_pass")), on).drop("src").withColumn("copies", taken)
    copies = blocks.where("copies > 0").select("source", "number", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), (F.col("copy") * F.col("in_pass") + F.col("turn")).alias("index"))

    def deal(batches):
        tree = SplittingTree(quotas, shards, seed)
        for b in batches:
            found = tree.shards_of(b.column("number").to_numpy(), b.column("index").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("number"), b.column("block"), b.column("copy"), pa.array(found)], ["number", "block", "copy", "shard"])

    shard = copies.select("number", "block", "copy", "index").mapInArrow(deal, "number int, block long, copy long, shard long")
    shard = shard.groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))  # two at most
    blocks = blocks.join(shard, ["number", "block"], "left").select(
        F.col("source").alias("src"), F.col("block").alias("nr"), "before", "words",
        F.coalesce(F.col("dealt.shard"), F.array().cast("array<long>")).alias("shards"),
    )
    at = dealt.join(blocks, F.col("source").eqNullSafe(F.col("src")) & (F.col("block") == F.col("nr"))).drop("src", "nr")
    last = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    whole = at.where(~last).withColumn("taken", F.size("shards") * F.col("size"))
    # The one block of each source that is taken in part: documents in hashed order, the last of them in part.
    order = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 2), "hash"), "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("size").over(order) - F.col("size")
    edge = at.where(last).withColumn("more", F.greatest(F.lit(0), F.least("size", F.col("rest") - start)))
    edge = edge.withColumn("taken", F.col("passes") * F.col("size") + F.col("more"))
    edge = edge.withColumn("shards", F.when(F.col("more") > 0, F.col("shards")).otherwise(F.slice("shards", 1, F.col("passes").cast("int"))))
    names = ["id", "source", "size", "source_size", "target", "taken", "shards"]
    return whole.select(*names).unionByName(edge.select(*names)), shards


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, shards: int | None = None) -> DataFrame:
    """The mixed rows themselves, with ``df``'s columns: each document as often as its shards say, in shard order.

    A copy that the plan takes in part comes whole if at least half of it is taken, else not at all. Rows that are equal
    in every column count as one. Each shard is one partition, shuffled by hash within.
    """
    names = df.columns
    row = whole_row(names)
    half = lambda k: F.hex(F.xxhash64(F.lit(seed + k), *row))
    docs = df.withColumn("__key", F.concat_ws("-", half(0), half(1))).dropDuplicates(["__key"])  # 128 bits
    plan, shards = _plan(docs, "__key", text, source, seed, shards)
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.size("shards")).cast("int")
    # A document without words takes no words: it comes as often as its block is drawn.
    plan = plan.select(F.col("id").alias("__id"), F.slice("shards", 1, F.least(copies, F.size("shards"))).alias("__shards")).where(F.size("__shards") > 0)
    rows = docs.join(plan, F.col("__key") == F.col("__id")).select(*names, "__key", F.posexplode("__shards").alias("__copy", "__shard"))
    order = F.xxhash64(F.lit(seed + 3), "__key", "__copy")
    return rows.repartitionById(shards, F.col("__shard").cast("int")).sortWithinPartitions(order, "__key", "__copy").select(*names)
