"""MinHash near-duplicate detection with DartMinHash signatures.

A text's elements are its five-word shingles, weighted by how often they occur; similarity is the weighted Jaccard
similarity of two texts. Hashed darts are thrown into regions of the (weight, rank) plane of each element: a region is
cut off by powers of two on both axes and gets a Poisson number of darts from the element's hash alone. A text takes
the darts below its weights and below a rank bound that falls with its total weight, deals them to k coordinates and
keeps the earliest per coordinate. Two texts agree on a coordinate with a chance that is their similarity. Bands of
coordinates are joined, and every link is verified on the texts.

No group is expanded into pairs: exact copies collapse into one node first, each node is held against one leader, and
only buckets whose members are still in different components are looked at again.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, cut, few, lean, mix64, shingles, slices, small_batches, word_hashes
from .components import components

BANDS, ROWS, WIDTH = 32, 6, 5
_POISSON: dict[int, np.ndarray] = {}


def _poisson_table(area: int) -> np.ndarray:
    """Cumulative chances of Poisson counts of mean ``area`` (a power of two)."""
    if area not in _POISSON:
        n = np.arange(int(area + 12 * math.sqrt(area) + 24))
        logs = n * math.log(area) - area - np.concatenate([[0.0], np.cumsum(np.log(n[1:]))])
        _POISSON[area] = np.cumsum(np.exp(logs))
    return _POISSON[area]


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _regions(limit: float):
    """(number, start, end) of [0,1), [1,2), [2,4), ... that begin below ``limit``."""
    number, start, end = 0, 0, 1
    while start < limit:
        yield number, start, end
        number, start, end = number + 1, end, end * 2


def darts(elements: np.ndarray, weights: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and ranks of all darts below the weights and the rank bound."""
    ids, ranks = [], []
    for wn, w0, w1 in _regions(float(weights.max())):
        inside = weights > w0
        e, w = (elements, weights) if inside.all() else (elements[inside], weights[inside])
        for rn, r0, r1 in _regions(bound):
            seed = mix64(e, 64 * wn + rn + 1)
            count = np.searchsorted(_poisson_table((w1 - w0) * (r1 - r0)), _unit(seed), "right")
            some = np.flatnonzero(count)
            at = np.repeat(some, count[some])
            if not len(at):
                continue
            n = count[some]
            j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            dart = mix64(seed[at] + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 7)
            rank = r0 + (r1 - r0) * _unit(mix64(dart, 8))
            good = rank <= bound
            if w1 - w0 > 1:
                good &= w0 + (w1 - w0) * _unit(mix64(dart, 9)) < w[at]
            ids.append(dart[good])
            ranks.append(rank[good])
    return np.concatenate(ids) if ids else np.zeros(0, np.uint64), np.concatenate(ranks) if ranks else np.zeros(0)


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The earliest dart of each of ``k`` coordinates; the rank bound grows until none is empty."""
    bound = (k * math.log(k) + 2 * k) / float(weights.sum())
    while True:
        ids, ranks = darts(elements, weights, bound)
        where = (mix64(ids, 10) % np.uint64(k)).astype(np.int64)
        order = np.argsort(-ranks, kind="stable")  # the last to be written, the earliest dart, stays
        out = np.zeros(k, np.uint64)
        filled = np.zeros(k, bool)
        out[where[order]] = ids[order]
        filled[where] = True
        if filled.all():
            return out
        bound *= 2


def band_keys(text_words: list[bytes], bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> tuple[np.ndarray, bytes]:
    """Keys of the bands, and one byte of each coordinate; both empty for texts without a shingle."""
    s = shingles(word_hashes(text_words), width)
    if not len(s):
        return np.zeros(0, np.int64), b""
    elements, weights = np.unique(s, return_counts=True)
    sig = signature(elements, weights, bands * rows).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = mix64(key * np.uint64(0xD6E8FEB86659FD93) + sig[:, r], r)
    return key.view(np.int64), mix64(sig, 11).astype(np.uint8).tobytes()


def node_of(words: list[bytes]) -> int | None:
    """A 64-bit id of the text's words; None for a text without words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else None


def weighted_jaccard(a: list[bytes], b: list[bytes], width: int = WIDTH) -> float:
    x, n = np.unique(shingles(word_hashes(a), width), return_counts=True)
    y, m = np.unique(shingles(word_hashes(b), width), return_counts=True)
    if not len(x) or not len(y):
        return float(a == b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (int(n.sum()) + int(m.sum()) - both)


def _features(df: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    small_batches(df)

    def run(batches):
        lean()
        for b in slices(batches):
            nodes, keys, sigs = [], [], []
            for t in b.column(1).to_pylist():
                words = (t or "").encode().split()
                nodes.append(node_of(words))
                key_, sig = band_keys(words, bands, rows)
                keys.append(key_)
                sigs.append(sig)
            offsets = np.zeros(len(keys) + 1, np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.int64()), lists, pa.array(sigs, pa.binary())], ["id", "node", "keys", "sig"])

    return df.select(F.col(key).alias("id"), text).mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, node long, keys array<long>, sig binary")


def _verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have a weighted Jaccard similarity of ``least`` or more."""

    def run(batches):
        last, words = None, []
        for b in slices(batches):
            good = []
            for n, x, y in zip(b.column("a").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                if n != last:
                    last, words = n, x.encode().split()
                good.append(weighted_jaccard(words, y.encode().split()) >= least)
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


#: Nodes of a bucket that are compared in one task, about, and how far below the least similarity an estimate from the
#: signatures may lie (four standard deviations at 192 coordinates).
BLOCK, SLACK = 512, 0.12


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (bucket, node, n, ...) dealt to pairs of blocks (i, j) of their bucket, so each pair of nodes meets."""
    n_blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node"), n_blocks.cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "blocks", "n")


def alike(sigs: np.ndarray, labels: np.ndarray, least: float) -> np.ndarray:
    """Which nodes have an estimated similarity of ``least`` or more to a node of another label."""
    out = np.zeros(len(sigs), bool)
    need = (least + (1 - least) / 256) * sigs.shape[1]  # bytes also agree by chance
    for s in range(0, len(sigs), 64):
        same = (sigs[s : s + 64, None, :] == sigs[None]).sum(2) >= need
        out[s : s + 64] = (same & (labels[s : s + 64, None] != labels)).any(1)
    return out


def exact_links(texts: list[list[bytes]], labels: np.ndarray, least: float, width: int = WIDTH) -> list[tuple[int, int]]:
    """Links between texts of different labels, enough to join what they join: shared cells counted by matrix products.

    The nth occurrence of a shingle in a text is a cell, so shared cells are the smaller of two counts, summed.
    """
    cells = []
    for w in texts:
        x, n = np.unique(shingles(word_hashes(w), width), return_counts=True)
        first = np.repeat(np.cumsum(n) - n, n)
        cells.append(mix64(np.repeat(x, n) + (np.arange(len(first)) - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 12))
    size = np.array([len(c) for c in cells])
    rows = np.repeat(np.arange(len(cells)), size)
    _, col, df = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
    common = df[col] > 1
    rows, col = rows[common], np.unique(col[common], return_inverse=True)[1]
    both = np.zeros((len(cells), len(cells)), np.float32)
    for c in range(0, int(col.max(initial=-1)) + 1, 4096):
        part = (col >= c) & (col < c + 4096)
        m = np.zeros((len(cells), 4096), np.float32)
        m[rows[part], col[part] - c] = 1
        both += m @ m.T
    good = both >= least * (size[:, None] + size - both) - 1e-6
    root = {k: k for k in labels.tolist()}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    out = []
    for a, b in np.argwhere(np.triu(good & (labels[:, None] != labels), 1)).tolist():
        p, q = find(int(labels[a])), find(int(labels[b]))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((a, b))
    return out


def _rest(at: DataFrame, sigs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links that join components which meet in a bucket: all pairs across components count, none becomes a row.

    Buckets go in blocks. Signatures tell which nodes may be near one of another component; only these are compared,
    exactly. ``at``: bucket, node, label.
    """
    split = at.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high")
    inside = at.join(split.select("bucket", "n"), "bucket").join(sigs, "node")

    def near(group: pa.Table) -> pa.Table:
        sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        good = alike(sig, group.column("label").to_numpy(), least - SLACK)
        return group.select(["bucket", "i", "j", "node", "label"]).filter(pa.array(good))

    columns = "bucket long, i int, j int, node long, label long"
    found = cut(_blocked(inside).groupBy("bucket", "i", "j").applyInArrow(near, columns))

    def join(group: pa.Table) -> pa.Table:
        nodes, labels = group.column("node").to_numpy(), group.column("label").to_numpy()
        pairs = exact_links([t.encode().split() for t in group.column("text").to_pylist()], labels, least)
        ends = np.array([(nodes[a], nodes[b]) for a, b in pairs], np.int64).reshape(-1, 2)
        return pa.table({"a": ends.min(1), "b": ends.max(1)}) if len(ends) else pa.table({"a": ends[:, 0], "b": ends[:, 1]})

    return found.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(join, "a long, b long").distinct()


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, bands: int = BANDS, rows: int = ROWS, salts: int = 8
) -> DataFrame:
    """Per row of ``df``: id (its key), class_id (the smallest key of its class), kept (whether it is that one).

    Classes are the connected components of the links: texts with equal words, and texts of five words or more whose
    weighted Jaccard similarity over five-word shingles is ``least`` or more. Texts that are null or without words are
    in no class: class_id is their own key. Rows with equal keys and texts are copies and all marked kept if their key
    is the smallest. The chance that a pair at 0.8 shares no band is (1 - 0.8^6)^32, below 0.0001.
    """
    rows_ = cut(_features(df, key, text, bands, rows))
    nodes = rows_.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"))
    nodes = cut(nodes)
    keyed = rows_.where(F.size("keys") > 0).select("node", "keys", "sig").dropDuplicates(["node"])
    dealt = keyed.select("node", F.explode("keys").alias("bucket"))
    buckets = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    salted = buckets.select("bucket", "n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    shared = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(salted, ["bucket", "salt"])
    shared = cut(shared.select("bucket", "node", "n"))
    # A bucket's leader is its node that meets most others in all its buckets: what a group was copied from, rather
    # than one copy among many that are less alike than each is to their source.
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    ranked = cut(shared.drop("n").join(weights, "node").select("bucket", F.struct("weight", "node").alias("rank")))
    leads = ranked.groupBy("bucket").agg(F.max("rank").alias("lead"))
    salted = leads.select("bucket", "lead", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    members = ranked.withColumn("salt", F.pmod(F.xxhash64("rank.node"), F.lit(salts)).cast("int")).join(salted, ["bucket", "salt"])
    members = cut(members.select("bucket", F.col("rank.node").alias("node"), "rank", "lead"))
    # Texts of the nodes that share a bucket with another, one row each, found by their smallest key.
    wanted = members.select("node").distinct().join(nodes, "node")

    def own(batches):
        for b in slices(batches):
            same = [node_of(t.encode().split()) == n for t, n in zip(b.column("text").to_pylist(), b.column("node").to_pylist(), strict=True)]
            yield b.filter(pa.array(same, pa.bool_()))

    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    texts = docs.join(few(wanted), "id").select("node", "text").mapInArrow(own, "node long, text string").dropDuplicates(["node"])
    staged = Staged(texts)
    texts = staged.df
    # First each node against the first leader of its buckets, then whatever of a bucket is in other components.
    first = members.groupBy("node").agg(F.max("lead").alias("lead"), F.max("rank").alias("rank")).where("lead > rank")
    links = cut(_verify(first.select(F.col("lead.node").alias("a"), F.col("node").alias("b")), texts, least))
    members = members.select("bucket", "node", F.col("lead.node").alias("lead"))
    labels = components(links)
    at = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    more = cut(_rest(at, keyed.select("node", "sig"), texts, least))
    if not more.isEmpty():
        links = links.unionByName(more)
        labels = components(links)
    staged.drop()
    ids = nodes.join(labels, "node", "left")
    lowest = ids.where("label is not null").groupBy("label").agg(F.min("id").alias("class_id"))
    classes = cut(ids.join(lowest, "label", "left").select("node", F.coalesce("class_id", "id").alias("class_id")))
    out = rows_.select("id", "node").join(classes, "node", "left")
    out = out.select("id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))
    return out.select("id", "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))
