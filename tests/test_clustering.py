"""Linkage without matrices of pairs, held against whole matrices, and its memory."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import clustering, graph


def made(seed, n, d, span):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + (seed % 2)
    return x / np.linalg.norm(x, axis=1, keepdims=True), rng.integers(0, span, n).astype(float)


def greedy(n, similarity, least):
    """Groups of rows: the most similar pair of groups joins while it has ``least`` or more; a group goes by its first row."""
    groups = {i: [i] for i in range(n)}
    while len(groups) > 1:
        best, a, b = max((similarity(groups[i], groups[j]), -i, -j) for i in groups for j in groups if i < j)
        if best < least:
            break
        groups[-a] += groups.pop(-b)
    label = np.empty(n, int)
    for first, rows in groups.items():
        label[rows] = first
    return label, groups


@pytest.mark.parametrize("seed", range(12))
def test_linkage_equals_whole_matrices(seed):
    x, t = made(seed, 24, 3, [5, 20, 60][seed % 3])
    gap = 10.0
    sim = np.where(np.abs(t[:, None] - t) > gap, -1.0, x @ x.T)
    want, _ = greedy(24, lambda a, b: sim[np.ix_(a, b)].mean(), 0.6)
    assert clustering.average_linkage(x, t, 0.4, gap).tolist() == want.tolist()

    high = t + seed % 4
    dots = x @ x.T

    def complete(a, b):
        rows = a + b
        return -1.0 if high[rows].max() - t[rows].min() > gap else dots[np.ix_(a, b)].min()

    want, groups = greedy(24, complete, 0.7)
    near = [(i, j) for i in sorted(groups) for j in sorted(groups) if i < j and complete(groups[i], groups[j]) >= 0.3]
    group, pairs = clustering.merge_close(x, t, high, 0.7, gap, 0.3)
    assert group.tolist() == want.tolist() and [p[:2] for p in pairs] == near
    assert all(abs(s - complete(groups[i], groups[j])) < 1e-9 for i, j, s in pairs)


def test_linkage_of_copies_and_of_one():
    x = np.repeat(np.eye(3), 5, axis=0)
    t = np.zeros(15)
    assert clustering.average_linkage(x, t, 0.1, 1.0).tolist() == [0] * 5 + [5] * 5 + [10] * 5
    assert clustering.average_linkage(x[:1], t[:1], 0.1, 1.0).tolist() == [0]
    assert clustering.average_linkage(x[:2], np.array([0.0, 2.0]), 0.1, 1.0).tolist() == [0, 1]
    assert clustering.merge_close(x, t, t, 0.9, 1.0)[0].tolist() == [0] * 5 + [5] * 5 + [10] * 5


def test_linkage_holds_no_matrix():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(400, 32)), 10, axis=0) + 0.2 * rng.normal(size=(4000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = rng.integers(0, 6 * 86400, 4000).astype(float)
    tracemalloc.start()
    label = clustering.average_linkage(x, t, 0.08, 3 * 86400.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(label.tolist())) < 1500 and peak < 10 * x.nbytes < 4000 * 4000  # a matrix of pairs has 128 MB


@pytest.mark.parametrize("kept", [0, 5000, 1 << 20])
def test_linkage_where_lists_of_near_rows_are_not_kept(monkeypatch, kept):
    x, t = made(5, 300, 4, 40)
    want = clustering.average_linkage(x, t, 0.3, 10.0)
    monkeypatch.setattr(clustering, "NEAR_BYTES", kept)
    assert clustering.average_linkage(x, t, 0.3, 10.0).tolist() == want.tolist() and 2 < len(set(want.tolist())) < 300


def test_links_are_fewer_than_rows_and_make_the_same_components(spark):
    x, t = made(2, 200, 3, 20)
    rows = [(k, "c", int(t[k]) * 3600, x[k].tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, country string, s long, vector array<double>").withColumn("at", F.timestamp_seconds("s"))
    pairs, links = clustering.near_pairs(df, 0.5, 1), clustering.near_links(df, 0.5, 1)
    assert links.count() < 2 * 200 < pairs.count()  # two time buckets
    assert sorted(map(tuple, graph.components(links).collect())) == sorted(map(tuple, graph.components(pairs).collect()))


def test_tasks_grow_with_pairs_of_blocks(spark, monkeypatch):
    """What a task sorts stays the same: tasks grow with the copies of vectors, and a pair of blocks is compared in strips."""
    x, t = made(4, 240, 3, 40)
    rows = [(k, "c", int(t[k]) * 3600, x[k].tolist()) for k in range(240)]
    df = spark.createDataFrame(rows, "id long, country string, s long, vector array<double>").withColumn("at", F.timestamp_seconds("s"))
    for name, value in (("BLOCK", 16), ("CELLS", 64), ("TASK_ROWS", 128)):
        monkeypatch.setattr(clustering, name, value)
    pairs, links = clustering.near_pairs(df, 0.5, 1), clustering.near_links(df, 0.5, 1)
    assert pairs.rdd.getNumPartitions() > 20 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = (x @ x.T >= 0.5) & (abs(t[:, None] - t) <= 24)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [(i, j) for i in range(240) for j in range(i + 1, 240) if near[i, j]]
    assert sorted(map(tuple, graph.components(links).collect())) == sorted(map(tuple, graph.components(pairs).collect()))


def test_related_clusters_are_not_one_task(spark, monkeypatch):
    """Centres that are all related but do not merge: none of them needs a component, and the pairs are those of the definition."""
    x, t = made(3, 60, 3, 30)
    rows = [(k, "c", int(t[k]) * 3600, x[k].tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, country string, s long, vector array<double>").withColumn("at", F.timestamp_seconds("s"))
    asked = []
    links = clustering.near_links
    monkeypatch.setattr(clustering, "near_links", lambda v, least, days: asked.append(least) or links(v, least, days))
    core, related = clustering.clusters(df, 0.999, 0.995, 1.0, 0.6)
    core, related = {r.id: r.core for r in core.collect()}, sorted((r.a, r.b) for r in related.collect())
    assert asked == [0.999, 0.995]  # nothing is linked at 0.6
    groups = sorted(set(core.values()))
    of = {g: [k for k in core if core[k] == g] for g in groups}
    want = []
    for a in groups:
        for b in groups:
            both = of[a] + of[b]
            if a < b and t[both].max() - t[both].min() <= 24 and len(of[a]) == len(of[b]) == 1 and x[a] @ x[b] >= 0.6:
                want.append((a, b))
    alone = [p for p in related if len(of[p[0]]) == len(of[p[1]]) == 1]
    assert alone == want and len(want) > 20
