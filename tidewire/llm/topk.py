"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of bounded size; each block's vectors and selection state travel to the candidates, which
never move. Every round scores everything and counts scores in bins of the range that holds a query's kth value; the
counts, added up over all tasks, tell which bin holds it, and the next round refines that bin. Once bins are one
integer wide the kth value is known: scores above it go out, and of those equal to it the smallest ids that are needed.

What tasks find travels packed, a row per task and 64 queries, and is added up as it arrives.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, cut

#: Queries in a block, bins in a round, and candidates scored at once.
BLOCK, BINS, ROWS = 8192, 128, 2048


def usable(vector: str) -> Column:
    """Neither null nor empty, and all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def _matrix(column: pa.ListArray, dims: int, scale: float) -> np.ndarray:
    """Integer components, floor(scale * x) of x as double; shorter vectors are filled up with zeros."""
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    n = np.diff(column.offsets.to_numpy())
    if (n == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(n), dims))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


#: Scores beyond this bound are given as the bound; larger ones don't fit a long.
FARTHEST = (1 << 62) - 1
#: Queries whose histograms or results travel as one row.
PART = 64


def top_k(
    df: DataFrame, k: int, is_query: Column, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, block: int = BLOCK
) -> DataFrame:
    """Per query row the ``k`` other rows of the highest inner product: query_id, rank (from 1), ``key``, score.

    Components are floor(scale * x), scores their exact integer inner products (``FARTHEST`` at most, either sign);
    ties go to the smaller key, and fewer than ``k`` come if there are fewer. Rows with a null key or an unusable
    vector (``usable``) take no part. Rows of equal keys are rows of their own: each is a candidate of the other, and
    each has its own results if it is a query. Vectors of unequal length meet on the components that both have.
    """
    spark = df.sparkSession
    rows = df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), is_query.alias("q"), F.col(vector).cast("array<double>").alias("v"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    square = F.aggregate(F.transform("v", lambda x: F.floor(x * scale).cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    norms = rows.select("q", F.size("v").alias("dims"), square.alias("norm"))
    n, dims, norm = norms.agg(F.count_if("q"), F.max("dims"), F.max("norm")).first()
    schema = T.StructType([T.StructField(x, t) for x, t in (("query_id", T.LongType()), ("rank", T.IntegerType()), (key, T.LongType()), ("score", T.LongType()))])
    if not n:
        return spark.createDataFrame([], schema)
    limit = int(norm) if norm < EXACT else FARTHEST
    blocks, out = -(-n // block), None
    for b in range(blocks):
        mine = rows.where(F.col("q") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)).select("row", "id", "v")
        shared = []
        part = _block(rows.select("row", "id", "v"), mine, k, dims, limit, scale, shared).withColumnRenamed("id", key)
        out = out.add(part) if out else Staged(part)
        for x in shared:
            x.destroy()
    return out.df


#: Sums of products are exact in doubles where squared norms stay below this.
EXACT = 1 << 53


def _scores(q: np.ndarray, c: np.ndarray, kind: type, limit: int) -> np.ndarray:
    """Integer inner products of all rows of ``q`` and ``c``; rows of large components by integers of any size."""
    with np.errstate(all="ignore"):
        large_q, large_c = ((x * x).sum(1) >= EXACT for x in (q, c))
        if not (large_q.any() or large_c.any()):
            return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
        out = np.where(large_q[:, None] | large_c, 0.0, np.where(large_q[:, None], 0, q) @ np.where(large_c[:, None], 0, c).T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x.tolist()], object)
    clip = lambda x: np.array(np.clip(x, -limit, limit), np.int64)
    if large_q.any():
        out[large_q] = clip(whole(q[large_q]) @ whole(c).T)
    if large_c.any():
        out[:, large_c] = clip(whole(q) @ whole(c[large_c]).T)
    return out


def _packed(q: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows of integers, of which ``q`` is a query's number, as one binary per ``PART`` queries."""
    flat, of = np.stack([q, *columns]).astype(np.int64), np.asarray(q) // PART
    order = np.argsort(of, kind="stable")
    parts, first = np.unique(of[order], return_index=True)
    data = [flat[:, x].tobytes() for x in np.split(order, first[1:])] if len(order) else []
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["part", "data"])


def _merged(packed: DataFrame, columns: int, n: int, result, schema: str) -> DataFrame:
    """``result(part, tables)`` of each part's packed tables, which come one by one: a task holds what it makes of them."""

    def run(batches):
        def tables():
            for b in batches:
                for part, data in zip(b.column("part").to_pylist(), b.column("data").to_pylist(), strict=True):
                    yield part, np.frombuffer(data, np.int64).reshape(columns, -1)

        for part, group in groupby(tables(), lambda x: x[0]):
            yield result(part, (t for _, t in group))

    parts = -(-n // PART)
    return packed.repartition(min(parts, 1024), "part").sortWithinPartitions("part").mapInArrow(run, schema)


def _block(candidates: DataFrame, queries: DataFrame, k: int, dims: int, limit: int, scale: float, shared: list) -> DataFrame:
    """query_id, rank, id, score of one block's queries; broadcasts are listed in ``shared``."""
    spark = candidates.sparkSession

    def share(x):
        shared.append(spark.sparkContext.broadcast(x))
        return shared[-1]

    table = queries.toArrow().combine_chunks()  # about ``block`` rows
    column = table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v")
    kind = np.float32 if limit < 1 << 24 else np.float64  # exact for integer sums below 2^24 and 2^53
    rows, ids = table.column("row").to_numpy(), table.column("id").to_numpy()
    n = len(rows)
    vectors = share((rows, ids, _matrix(column, dims, scale)))
    low, width = np.full(n, -limit, np.int64), 2 * limit + 1

    def scored(batches):
        """(first query, scores of queries by candidates, ids and rows of candidates); a query's own row scores below all."""
        q_rows, _, q = vectors.value
        for b in batches:
            for s in range(0, b.num_rows, ROWS):
                part = b.slice(s, ROWS)
                c = _matrix(pa.array(part.column("v")), dims, scale)
                c_ids, c_rows = part.column("id").to_numpy(), part.column("row").to_numpy()
                order = np.argsort(c_rows)
                for f in range(0, n, ROWS):
                    scores = _scores(q[f : f + ROWS], c, kind, limit)
                    at = np.minimum(np.searchsorted(c_rows[order], q_rows[f : f + ROWS]), len(c_rows) - 1)
                    own = np.flatnonzero(c_rows[order][at] == q_rows[f : f + ROWS])
                    scores[own, order[at[own]]] = np.iinfo(np.int64).min
                    yield f, scores, c_ids, c_rows

    while width > 1:
        step = -(-width // BINS)
        state = share((low, step))

        def count(batches, state=state):
            low, step = state.value
            hist = np.zeros((n, BINS + 1), np.int64)  # the last bin is for scores above the range
            for f, scores, _, _ in scored(batches):
                m = len(scores)
                inside = scores >= low[f : f + m, None]
                at, c = np.nonzero(inside)
                bins = np.minimum((scores[at, c] - low[f + at]) // step, BINS)
                hist[f : f + m] += np.bincount(at * (BINS + 1) + bins, minlength=m * (BINS + 1)).reshape(m, BINS + 1)
            # Bins below this task's own kth score can't hold the kth score of all.
            above = np.cumsum(hist[:, ::-1], 1)[:, ::-1]
            q, b = np.nonzero((hist > 0) & (above - hist < k))
            yield _packed(q, b, hist[q, b])

        def locate(part, tables):
            hist = np.zeros((PART, BINS + 1), np.int64)
            for q, b, m in tables:
                np.add.at(hist, (q - part * PART, b), m)
            above = np.cumsum(hist[:, ::-1], 1)[:, ::-1] >= k
            q = np.flatnonzero(above[:, 0])
            return pa.RecordBatch.from_arrays([pa.array(q + part * PART), pa.array(above[q].sum(1) - 1)], ["q", "bin"])

        found = _merged(candidates.mapInArrow(count, "part long, data binary"), 3, n, locate, "q long, bin long").toArrow()
        q, b = found.column("q").to_numpy(), found.column("bin").to_numpy()  # a row a query at most
        new = low.copy()  # with fewer than k scores the range's lower end stays and everything goes out
        new[q] = low[q] + np.minimum(b, BINS) * step
        low, width = new, step

    state = share(low)

    def best(table: np.ndarray) -> np.ndarray:
        """Of rows (query, id, row, score) the best k of each query, in order."""
        table = table[:, np.lexsort((table[2], table[1], -table[3], table[0]))]
        first = np.flatnonzero(np.diff(table[0], prepend=-1))
        return table[:, np.arange(table.shape[1]) - np.repeat(first, np.diff(first, append=table.shape[1])) < k]

    def give(batches):
        low, mine = state.value, np.zeros((4, 0), np.int64)
        for f, scores, c_ids, c_rows in scored(batches):
            q, c = np.nonzero(scores >= low[f : f + len(scores), None])
            mine = best(np.concatenate([mine, np.stack([f + q, c_ids[c], c_rows[c], scores[q, c]])], 1))
        yield _packed(*mine)

    def finish(part, tables):
        mine, more = np.zeros((4, 0), np.int64), []
        for t in tables:
            more.append(t)
            if sum(x.shape[1] for x in more) > 16 * PART * k:
                mine, more = best(np.concatenate([mine, *more], 1)), []
        mine = best(np.concatenate([mine, *more], 1))
        first = np.flatnonzero(np.diff(mine[0], prepend=-1))
        rank = np.arange(mine.shape[1]) - np.repeat(first, np.diff(first, append=mine.shape[1])) + 1
        columns = (vectors.value[1][mine[0]], rank.astype(np.int32), mine[1], mine[3])
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["query_id", "rank", "id", "score"])

    packed = candidates.mapInArrow(give, "part long, data binary")
    return _merged(packed, 4, n, finish, "query_id long, rank int, id long, score long")
