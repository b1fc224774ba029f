"""Articles to stories: near pairs in time, average-linkage clusters, merging of close clusters, borrowed coverage.

Average linkage joins two clusters only if some pair across them is near enough, so every cluster lies inside one
connected component of the graph of near pairs: components come first, and only they enter numpy. Clusters are merged
and absorbed by their centres and representatives; for these steps components of the graph of near centres come first,
and numpy sees a row per cluster, not its articles. A component is one task's, which holds its vectors a few times over
but never their pairs: 100,000 vectors of 384 numbers take 0.3 GB a copy, some 2 GB in all. A component beyond a task's
memory fails that task rather than giving other clusters; a higher similarity or fewer days cut it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text, vectors
from . import stories
from .graph import components, cut

#: Vectors of a block, about: each vector is copied once for each block of its time bucket. Cells of similarities that a
#: task holds at once.
BLOCK, CELLS = 4096, 1 << 20
#: Vectors that a task sorts by pairs of blocks, about, however many pairs there are in all.
TASK_ROWS = 1 << 16


def _forest(p: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that link the ``n`` rows as the pairs (p, q) do, fewer than rows: of each row and the first one that it is linked to."""
    root = np.arange(n)
    while True:
        low, before = np.minimum(root[p], root[q]), root.copy()
        np.minimum.at(root, root[p], low)
        np.minimum.at(root, root[q], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            linked = np.flatnonzero(root != np.arange(n))
            return root[linked], linked


def near_links(vecs: DataFrame, least: float, days: float, by: str = "country") -> DataFrame:
    """(a, b) that make the components of ``near_pairs``: of the pairs that a task finds, as many as it has rows at most."""
    return near_pairs(vecs, least, days, by, links=True).select("a", "b")


def near_pairs(vecs: DataFrame, least: float, days: float, by: str = "country", links: bool = False) -> DataFrame:
    """(a, b, sim) of vectors (id, ``by``, at, vector) of one group, at most ``days`` apart, with cosine ``least`` or more.

    Times fall into buckets as long as the gap; each vector meets its own and the next bucket. Buckets are dealt to
    pairs of blocks, and a pair of blocks is matrix products of bounded size. Pairs of blocks grow with the square of a
    bucket, so tasks do too: what one of them sorts and holds stays the same.
    """
    gap = int(days * 86400)
    v = vecs.select("id", F.col(by).alias("g"), F.unix_timestamp("at").alias("t"), F.col("vector").cast("array<double>").alias("v"))
    own = F.floor(F.col("t") / gap)
    v = v.select("*", F.explode(F.array(F.struct(own.alias("k"), F.lit(False).alias("late")), F.struct((own - 1).alias("k"), F.lit(True).alias("late")))).alias("x"))
    v = v.select("id", "g", "t", "v", "x.k", "x.late")
    sizes = v.groupBy("g", "k").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count_if(~F.col("late")).alias("own")).where("own > 0")
    sizes = cut(sizes.drop("own"))
    copies = sizes.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0
    tasks = max(int(vecs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-copies // TASK_ROWS))
    v = v.join(sizes.drop("rows"), ["g", "k"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    v = v.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    v = v.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    kind = vecs.schema["id"].dataType

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        ids, t, late = (group.column(n).to_numpy() for n in ("id", "t", "late"))
        x = np.concatenate([np.array(b.column("v").to_pylist(), np.float64) for b in group.to_batches(1024)])
        x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
        block, i, j = group.column("block").to_numpy(), group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)

        def pairs(found: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
            a, b = ids[p], ids[q]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(found)], ["a", "b", "sim"])

        linked = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(1, CELLS // max(1, len(right)))
        for start in range(0, len(left), step):
            some = left[start : start + step]
            sim = x[some] @ x[right].T
            good = (sim >= least) & (np.abs(t[some, None] - t[right]) <= gap) & ~(late[some, None] & late[right])
            if i == j:
                good &= some[:, None] < right
            p, q = np.nonzero(good)
            found, p, q = sim[p, q], some[p], right[q]
            if links:
                linked = _forest(np.append(linked[0], p), np.append(linked[1], q), len(ids))
            else:
                yield pairs(found, p, q)
        if links:
            yield pairs(np.full(len(linked[0]), np.nan), *linked)

    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("sim", T.DoubleType())])
    by_pair = ["g", "k", "i", "j"]
    return v.repartition(tasks, *by_pair).groupBy(*by_pair).applyInArrow(compare, schema)


#: Bytes of lists of near rows that a task keeps; rows beyond find theirs anew each time.
NEAR_BYTES = 512 << 20


class _Near:
    """The rows near each row, rows in order of time: those of a similarity of ``least`` or more, at most ``gap`` apart."""

    def __init__(self, rows: np.ndarray, times: np.ndarray, least: float, gap: float):
        self.rows, self.least = rows, least - 1e-9
        self.lo, self.hi = np.searchsorted(times, times - gap), np.searchsorted(times, times + gap, "right")
        self.lists: list[np.ndarray] = []
        held = 0
        while len(self.lists) < len(rows) and held < NEAR_BYTES:
            i = len(self.lists)
            e = min(len(rows), i + max(1, rows.size // (2 * int(self.hi[i] - self.lo[i]))))  # as many numbers as half the vectors, about
            found = self._found(i, e)
            held += sum(f.nbytes + 112 for f in found)
            self.lists += found

    def _found(self, i: int, e: int) -> list[np.ndarray]:
        first = self.lo[i]
        at, near = np.nonzero(self.rows[i:e] @ self.rows[first : self.hi[e - 1]].T >= self.least)
        near = (near + first).astype(np.int32)
        good = (near >= self.lo[i:e][at]) & (near < self.hi[i:e][at]) & (near != at + i)
        return np.split(near[good], np.searchsorted(at[good], np.arange(1, e - i)))

    def of(self, members: np.ndarray) -> np.ndarray:
        lists = [self.lists[i] if i < len(self.lists) else self._found(i, i + 1)[0] for i in members.tolist()]
        return lists[0] if len(lists) == 1 else np.concatenate(lists)


def _chain(nearest, join, settle, first, enough) -> None:
    """Joins clusters pair by pair along chains of nearest neighbours, until no pair is similar ``enough``.

    Linkages by mean or by extremes bring no joined cluster nearer to a third than its parts were. So two clusters that are
    each other's nearest may join at once, whatever else is open, and one whose nearest isn't near enough is settled for
    good; the clusters are those of joining the nearest pair of all each time. Similarities that differ by less than
    1e-12 are equal; the one before in the chain goes first, then the smaller cluster number.
    """
    path: list[int] = []
    while path or (start := first()) is not None:
        if not path:
            path.append(start)
        ids, sim = nearest(path[-1])
        best = int(sim.argmax()) if len(sim) else -1
        if best < 0 or not enough(sim[best]):
            settle(path[-1])
            path = []
            continue
        before = path[-2] if len(path) > 1 else None
        if before is not None and sim[np.searchsorted(ids, before)] >= sim[best] - 1e-12:
            join(*sorted(path[-2:]))
            del path[-2:]
        else:
            path.append(int(ids[best]))


def average_linkage(x: np.ndarray, t: np.ndarray, cut: float, gap: float) -> np.ndarray:
    """Labels (a cluster's smallest row) by average linkage on cosine distance of unit vectors; pairs further apart in time
    than ``gap`` count as distance 2.

    No matrix of pairs is made. Clusters join only if some pair across them is near enough, so a cluster looks at those of
    the rows near its own (``_Near``) and at no others: the mean similarity of two clusters is the product of their sums;
    where their joint span is longer than the gap, each row of the one takes the sum of the rows of the other that are in
    its reach, a difference of two running sums in order of time. Memory is that of about five copies of the vectors,
    and ``NEAR_BYTES`` at most for the rows near each row.
    """
    order = np.argsort(t, kind="stable")
    rows, times, label = x[order], t[order], order.copy()  # in order of time
    near = _Near(rows, times, 1 - cut, gap)
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    members: dict[int, np.ndarray] = {}  # places of the rows of joined clusters, in order of time
    open_, sums, size, low, high = np.ones(len(x), bool), x.copy(), np.ones(len(x)), t.copy(), t.copy()
    next_open = 0

    def of(c: int) -> np.ndarray:
        return members[c] if c in members else place[c : c + 1]

    def nearest(c: int) -> tuple[np.ndarray, np.ndarray]:
        mine = of(c)
        ids = np.unique(label[near.of(mine)])
        ids = ids[open_[ids] & (ids != c)]
        total = sums[ids] @ sums[c]
        part = np.flatnonzero(np.maximum(high[ids], high[c]) - np.minimum(low[ids], low[c]) > gap)
        if len(part):
            running = np.vstack([np.zeros(x.shape[1]), np.cumsum(rows[mine], axis=0)])
            total[part] = 0.0
            theirs = [of(k) for k in ids[part].tolist()]
            met, whose = np.concatenate(theirs), np.repeat(part, [len(k) for k in theirs])
            for k in range(0, len(met), 4096):
                p = met[k : k + 4096]
                lo, hi = np.searchsorted(times[mine], times[p] - gap), np.searchsorted(times[mine], times[p] + gap, "right")
                np.add.at(total, whose[k : k + 4096], np.einsum("nd,nd->n", running[hi] - running[lo], rows[p]) - (len(mine) - (hi - lo)))
        return ids, total / (size[ids] * size[c])

    def join(a: int, b: int) -> None:
        sums[a] += sums[b]
        size[a] += size[b]
        low[a], high[a], open_[b] = min(low[a], low[b]), max(high[a], high[b]), False
        label[of(b)] = a
        members[a] = np.sort(np.concatenate([of(a), of(b)]))
        members.pop(b, None)

    def settle(c: int) -> None:
        open_[c] = False

    def first() -> int | None:
        nonlocal next_open
        while next_open < len(x) and not open_[next_open]:
            next_open += 1
        return next_open if next_open < len(x) else None

    _chain(nearest, join, settle, first, lambda s: 1 - s < cut)
    out = np.empty(len(x), label.dtype)
    out[order] = label
    return out


def merge_close(centre: np.ndarray, low: np.ndarray, high: np.ndarray, least: float, gap: float, related: float = 2.0) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(group of each cluster, pairs of groups of ``related`` similarity or more that stay apart).

    Unit centres; groups join while their least similarity, over all pairs of first centres across them, is ``least`` or
    more and their joint span is ``gap`` or less. A group goes by its first cluster. Similarities are made anew for one
    group at a time, so memory grows with the clusters, not with their pairs.
    """
    n = len(centre)
    group, low, high = np.arange(n), low.astype(float).copy(), high.astype(float).copy()
    alive, open_ = np.ones(n, bool), np.ones(n, bool)

    def similar(k: int) -> np.ndarray:
        """Least similarity of group ``k`` to each group, -1 where they may not join."""
        least_of, mine = np.full(n, np.inf), np.flatnonzero(group == k)
        for part in np.array_split(mine, len(mine) // 64 + 1):
            np.minimum(least_of, (centre @ centre[part].T).min(1), out=least_of)
        sim = np.full(n, np.inf)
        np.minimum.at(sim, group, least_of)
        span = np.maximum(high[k], high) - np.minimum(low[k], low)
        sim = np.where((span <= gap) & alive, sim, -1.0)
        sim[k] = -1.0
        return sim

    def join(i: int, j: int) -> None:
        low[i], high[i], alive[j], open_[j] = min(low[i], low[j]), max(high[i], high[j]), False, False
        group[group == j] = i

    def settle(k: int) -> None:
        open_[k] = False

    ids = np.arange(n)
    _chain(lambda k: (ids, similar(k)), join, settle, lambda: int(open_.argmax()) if open_.any() else None, lambda s: s >= least)
    pairs = []
    for i in np.flatnonzero(alive).tolist():
        sim = similar(i)
        pairs += [(i, int(j), float(sim[j])) for j in np.flatnonzero(sim >= related) if j > i]
    return group, pairs


def absorb(
    mean: np.ndarray, rep: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, abroad: np.ndarray, least: float, gap: float, most: int = 6
) -> np.ndarray:
    """Which cluster each cluster goes to (itself, if none): small ones join the larger one they are closest to.

    Clusters are in order of their labels. What can be told of a pair on its own is told for a block of small clusters at
    a time; the walk over them then only keeps account of who is gone and how many articles (``most``) a cluster still takes.
    """
    n = len(size)
    label = np.arange(n)
    small = np.flatnonzero((size <= 2) | ((size <= 4) & abroad))
    into, room = label.copy(), np.full(n, most)
    for part in np.array_split(small, len(small) // 256 + 1):
        larger = (size > size[part, None]) | ((size == size[part, None]) & (label < part[:, None]))
        span = np.maximum(high[part, None], high) - np.minimum(low[part, None], low)
        sims = np.maximum(mean[part] @ mean.T, rep[part] @ rep.T)
        sims = np.where(larger & (span <= gap) & (sims >= least), sims, -np.inf)
        for b, sim in zip(part.tolist(), sims):
            choice = np.where((into == label) & (room >= size[b]), sim, -np.inf)
            a = n - 1 - int(choice[::-1].argmax())  # the last of equals
            if choice[a] > -np.inf:
                into[b] = a
                room[a] -= size[b]
    while (into[into] != into).any():  # whom a cluster went to may have gone on itself
        into = into[into]
    return into


def summaries(vecs: DataFrame, label: str) -> DataFrame:
    """Per cluster: label, country, size, low and high (seconds), abroad, mean (of unit vectors), centre (mean, as unit vector)."""
    t = F.unix_timestamp("at")
    facts = vecs.groupBy(label).agg(F.first("country").alias("country"), F.count("*").alias("size"), F.min(t).alias("low"), F.max(t).alias("high"), F.max("abroad").alias("abroad"))
    means = vectors.mean_vectors(vecs.withColumn("unit", vectors.unit("vector")), [label], "unit", "mean")
    return facts.join(means, label).withColumn("centre", vectors.unit("mean"))


def _picked(vecs: DataFrame, of: DataFrame, label: str) -> DataFrame:
    """(label, rep_id, rep): the article that speaks for each cluster and its unit vector; by nearness to the centre, and
    by what its outlet and title are where the columns tell."""
    rows = vecs.join(of.select(label, "centre"), label).withColumn("unit", vectors.unit("vector")).withColumn("sim", vectors.dot("unit", "centre"))
    if {"url", "syndicated_of", "title", "scope", "kind", "factuality", "source_id"} <= set(vecs.columns):
        best = stories.representatives(rows.withColumnRenamed(label, "story_id")).select(F.col("story_id").alias(label), F.col("id").alias("rep_id"))
    else:
        best = rows.groupBy(label).agg(F.max_by("id", F.struct(F.round("sim", 9), -F.col("id"))).alias("rep_id"))
    return best.join(rows.select(F.col("id").alias("rep_id"), F.col("unit").alias("rep")), "rep_id")


def _prepared(vecs: DataFrame) -> DataFrame:
    abroad = F.col("scope").isin("international", "abroad_local") if "scope" in vecs.columns else F.lit(False)
    return vecs.withColumn("abroad", F.coalesce(abroad, F.lit(False)))


def clusters(vecs: DataFrame, similarity: float = 0.92, merge: float = 0.95, days: float = 3.0, related: float = 0.925) -> tuple[DataFrame, DataFrame]:
    """((id, core) of every vector (id, country, at, vector), (a, b, sim) of related clusters): average linkage, then
    complete linkage of centres. A cluster goes by its smallest id."""
    gap, kind = days * 86400, vecs.schema["id"].dataType.simpleString()
    comp = components(near_links(vecs, similarity, days))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack([np.asarray(v, float) for v in pdf["vector"]])
        x /= np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
        label = average_linkage(x, pdf["t"].to_numpy(float), 1 - similarity, gap)
        return pd.DataFrame({"id": pdf["id"], "first": pdf.groupby(label)["id"].transform("min")})

    rows = vecs.join(comp, vecs["id"] == comp["node"], "left").select("id", "component", F.unix_timestamp("at").alias("t"), "vector")
    linked = rows.where("component is not null").groupBy("component").applyInPandas(link, f"id {kind}, first {kind}")
    linked = cut(linked.unionByName(rows.where("component is null").select("id", F.col("id").alias("first"))))
    facts = cut(summaries(_prepared(vecs).join(linked, "id"), "first"))
    at = facts.select(F.col("first").alias("id"), "country", F.timestamp_seconds("low").alias("at"), F.col("centre").alias("vector"))
    close = components(near_links(at, merge, days))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", ignore_index=True)
        centre = np.stack([np.asarray(v, float) for v in pdf["centre"]])
        group, _ = merge_close(centre, pdf["low"].to_numpy(), pdf["high"].to_numpy(), merge, gap)
        return pd.DataFrame({"first": pdf["first"], "core": pdf["first"].to_numpy()[group]})

    met = facts.join(close, F.col("first") == F.col("node")).select("first", "component", "low", "high", "centre")
    done = cut(met.groupBy("component").applyInPandas(join, f"first {kind}, core {kind}"))
    core = linked.join(done, "first", "left").select("id", F.coalesce("core", "first").alias("core"))
    return core, _related(at, facts.join(done, "first", "left").withColumn("core", F.coalesce("core", "first")), related, days, gap)


def _related(at: DataFrame, facts: DataFrame, least: float, days: float, gap: float) -> DataFrame:
    """(a, b, sim) of groups whose least similarity is ``least`` or more and whose joint span is ``gap`` or less: those of
    which all pairs across are near. ``at``: first centres; ``facts``: first, core, low, high."""
    group = facts.groupBy("core").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    of = cut(facts.select("first", "core").join(group, "core"))
    side = lambda k: of.select(F.col("first").alias(k), F.struct("core", "n", "low", "high").alias(f"of_{k}"))
    met = near_pairs(at, least, days).join(side("a"), "a").join(side("b"), "b").where("of_a.core <> of_b.core")
    met = met.where(F.greatest("of_a.high", "of_b.high") - F.least("of_a.low", "of_b.low") <= gap)
    x, y = F.least("of_a", "of_b"), F.greatest("of_a", "of_b")
    met = met.select(x.alias("x"), y.alias("y"), "sim").groupBy(F.col("x.core").alias("a"), F.col("y.core").alias("b"))
    met = met.agg(F.min("sim").alias("sim"), F.count("*").alias("n"), F.any_value(F.col("x.n") * F.col("y.n")).alias("all"))
    return met.where("n = all").select("a", "b", "sim")


def cluster(vecs: DataFrame, similarity: float = 0.92, merge: float = 0.95, borrow: float = 0.895, days: float = 3.0) -> DataFrame:
    """(id, core, story) of every vector (id, country, at, vector[, scope and what makes a representative]): core is its
    cluster, story the one that its cluster was absorbed by, or the same; both go by their smallest core id."""
    gap, kind = days * 86400, vecs.schema["id"].dataType.simpleString()
    core, _ = clusters(vecs, similarity, merge, days)
    core = cut(core)
    rows = _prepared(vecs).join(core, "id")
    facts = cut(summaries(rows, "core"))
    facts = cut(facts.join(_picked(rows, facts, "core"), "core"))
    near = lambda c: near_links(facts.select(F.col("core").alias("id"), "country", F.timestamp_seconds("low").alias("at"), F.col(c).alias("vector")), borrow, days)
    comp = components(near("centre").unionByName(near("rep")))  # a mean is no longer than a centre

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("core", ignore_index=True)
        mean, rep = (np.stack([np.asarray(v, float) for v in pdf[c]]) for c in ("mean", "rep"))
        into = absorb(mean, rep, *(pdf[c].to_numpy() for c in ("size", "low", "high", "abroad")), borrow, gap)
        return pd.DataFrame({"core": pdf["core"], "story": pdf["core"].to_numpy()[into]})

    met = facts.join(comp, F.col("core") == F.col("node")).select("core", "component", "size", "low", "high", "abroad", "mean", "rep")
    into = met.groupBy("component").applyInPandas(take, f"core {kind}, story {kind}")
    return core.join(into, "core", "left").select("id", "core", F.coalesce("story", "core").alias("story"))


def assemble(vecs: DataFrame, members: DataFrame, days: float = 3.0, low: float = 0.86, mid: float = 0.895, high: float = 0.925) -> DataFrame:
    """(story_id, id, band, similarity): the rows of each story of ``cluster``'s result.

    Core articles count 0.93 or more, the representative 1; absorbed ones 0.85 to 0.929. Stories of one article that
    absorbed none lend it to the closest larger story too: close ones at 0.85 to 0.929, broad ones at 0.75 to 0.849.
    """
    rows = _prepared(vecs).join(members, "id")
    held = rows.where("core = story")
    facts = cut(summaries(held, "story"))
    facts = cut(facts.join(_picked(held, facts, "story"), "story"))
    whole = rows.groupBy("story").agg(F.count("*").alias("n"))
    near = rows.withColumn("unit", vectors.unit("vector")).join(facts.select("story", "rep_id", "rep", "centre", "mean"), "story")
    sim = F.greatest(vectors.dot("unit", "mean"), vectors.dot("unit", "rep"))
    grade = F.round(text.calibrate(sim), 3)
    own = near.select(
        F.col("story").alias("story_id"), "id",
        F.when(F.col("id") == F.col("rep_id"), "representative").when(F.col("core") == F.col("story"), "core").otherwise("absorbed").alias("band"),
        F.when(F.col("id") == F.col("rep_id"), 1.0).when(F.col("core") == F.col("story"), F.greatest(F.lit(0.93), grade)).otherwise(F.least(F.lit(0.929), F.greatest(F.lit(0.85), grade))).alias("similarity"),
    )
    larger = facts.join(whole.where("n > 1").select("story"), "story")
    centres = larger.select(F.col("story").alias("story_id"), "country", F.timestamp_seconds("low").alias("first_at"), F.timestamp_seconds("high").alias("last_at"), F.col("mean").alias("centre"), F.col("rep").alias("representative"))
    loose = rows.join(whole.where("n = 1").select("story"), "story", "left_semi").select("id", "country", "at", vectors.unit("vector").alias("vector"))
    bands = attach_bands(centres, loose, days, low, mid, high)
    grade = F.round(text.calibrate(F.col("sim")), 3)
    lent = F.when(F.col("band") == "close", F.least(F.lit(0.929), F.greatest(F.lit(0.85), grade))).otherwise(F.least(F.lit(0.849), F.greatest(F.lit(0.75), grade)))
    return own.unionByName(bands.select("story_id", "id", "band", lent.alias("similarity")))


def attach_bands(centres: DataFrame, loose: DataFrame, days: float, low: float, mid: float, high: float, most: int = 6) -> DataFrame:
    """(story_id, id, band, sim): single articles borrowed by their one closest story, ``most`` per story and band.

    ``centres``: story_id, country, first_at, last_at, centre, representative; an article is as close as the closer of
    the centre and the representative's vector.
    """
    gap = int(days * 86400)
    seconds = lambda c: F.unix_timestamp(c)
    near_k = lambda t: F.floor(t / gap)
    c = centres.select("story_id", "country", seconds("first_at").alias("f"), seconds("last_at").alias("l"), "centre", "representative")
    c = c.withColumn("k", F.explode(F.sequence(near_k(F.col("l") - gap), near_k(F.col("f") + gap))))  # the buckets in reach
    a = loose.select("id", "country", seconds("at").alias("t"), "vector").withColumn("k", near_k(F.col("t")))
    met = a.join(c, ["country", "k"]).where(F.greatest("l", "t") - F.least("f", "t") <= gap)
    met = met.withColumn("sim", F.greatest(vectors.dot("vector", "centre"), vectors.dot("vector", "representative")))
    met = met.where((F.col("sim") >= low) & (F.col("sim") < high))
    best = met.groupBy("id").agg(F.max_by(F.struct("story_id", "sim"), F.struct(F.round("sim", 9), -F.col("story_id"))).alias("b"))
    rows = best.select("b.story_id", "id", "b.sim", F.when(F.col("b.sim") >= mid, "close").otherwise("broad").alias("band"))
    w = Window.partitionBy("story_id", "band").orderBy(F.desc(F.round("sim", 9)), "id")
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")


def calibrated(df: DataFrame) -> DataFrame:
    return df.withColumn("similarity", F.round(text.calibrate("sim"), 3))
