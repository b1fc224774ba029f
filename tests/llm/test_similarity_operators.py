"""Near duplicates, repeated passages, top-k search, mixing, quotations and the pipeline."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidewire.llm import common, components, minhash, mixing, quotes, substrings, topk
from tidewire.llm.common import few, shingles, word_hashes

WORDS = [a + b for a in "ba ke li mo nu ra se ti".split() for b in "lan der mic sol tur wen".split()]


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_darts_estimate_weighted_similarity():
    rng = random.Random(1)
    a = text_of(rng, 400).split()
    b = a[:300] + text_of(rng, 100).split()
    enc = lambda w: [x.encode() for x in w]
    sig = [minhash.signature(*np.unique(shingles(word_hashes(enc(w)), 5), return_counts=True), 2048) for w in (a * 2, b)]
    assert abs((sig[0] == sig[1]).mean() - minhash.weighted_jaccard(enc(a * 2), enc(b))) < 0.05
    short = minhash.signature(np.array([5], np.uint64), np.array([3]), 64)
    assert len(set(short.tolist())) == 64


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    base = [text_of(rng, n) for n in (30, 120, 400, 60, 200)]
    texts = [t for b in base for t in (b, b, " ".join("changed" if k == 17 else w for k, w in enumerate(b.split())))]
    chain = base[2].split()
    for k in range(6):  # a drift: neighbours are alike, the ends are not
        chain = [text_of(rng, 1) + str(k) if 60 * k < j < 60 * k + 16 else w for j, w in enumerate(chain)]
        texts.append(" ".join(chain))
    texts += ["", "  ", None, "four words are here", "four words are here", "one", text_of(rng, 9000)] + [text_of(rng, 80) for _ in range(10)]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "without a key at all", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = {r.id: r.class_id for r in minhash.near_duplicates(df).collect()}
    assert minhash.near_duplicates(df).count() == len(rows)
    words = [(t or "").encode().split() for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if words[i] and (words[i] == words[j] or minhash.weighted_jaccard(words[i], words[j]) >= 0.8 and len(words[i]) > 4):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {k: got[k] for k in range(len(texts))} == {k: find(k) for k in range(len(texts))}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 301), (301, 300), (302, 302)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[100 + k] for k in range(30)} == {100} and got[301] == 300 and 302 not in got


def test_compact_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, t = int(rng.integers(1, 40)), int(rng.integers(1, 9))
        h = rng.integers(0, 12, n).astype(np.uint64) << np.uint64(30)
        seen = {}
        for l, c, r in zip(*(x.tolist() for x in substrings.compact_windows(h, t)), strict=True):
            for i in range(l, c + 1):
                for j in range(max(c, i + t - 1), r + 1):
                    assert (i, j) not in seen
                    seen[i, j] = c
        for i in range(n):
            for j in range(i + t - 1, n):
                assert h[seen[i, j]] == h[i : j + 1].min()


def test_windows_of_many_texts_at_once():
    rng = np.random.default_rng(5)
    for _ in range(60):
        t = int(rng.integers(1, 7))
        texts = [rng.integers(0, 9, int(rng.integers(t, 30))).astype(np.uint64) << np.uint64(30) for _ in range(5)]
        of = np.repeat(np.array([2, 3, 7, 8, 20]), [len(x) for x in texts])
        found = np.stack(substrings.compact_windows(np.concatenate(texts), t, of), 1)
        alone, at = [], 0
        for x in texts:
            alone.append(np.stack(substrings.compact_windows(x, t), 1) + at)
            at += len(x)
        assert sorted(map(tuple, found.tolist())) == sorted(map(tuple, np.concatenate(alone).tolist()))


def test_repeated_passages(spark):
    rng = random.Random(4)
    passage, other = text_of(rng, 70), text_of(rng, 60)
    edited = " ".join("edited" if k == 35 else w for k, w in enumerate(passage.split()))
    own = text_of(rng, 55)
    texts = [
        text_of(rng, 40) + " " + passage + " " + text_of(rng, 30),
        text_of(rng, 90),
        passage + " " + text_of(rng, 25),
        text_of(rng, 33) + " " + edited + " " + text_of(rng, 60) + " " + other,
        own + " " + text_of(rng, 9) + " " + own,
        other + "\n" + text_of(rng, 5000),
        "", None, "short",
    ]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, passage, None), (5, texts[5], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    result = substrings.repeated_passages(df)
    got = {r.id: r for r in result.collect()}
    assert result.count() == len(rows)
    spans = lambda k: [(s.start, s.end) for s in got[k].spans]
    assert spans(0) == spans(1) == spans(4) == spans(6) == spans(7) == spans(8) == []
    assert spans(2) == [(0, 70)] and got[2].sources == [0]
    assert len(spans(3)) == 1 and spans(3)[0][0] <= 36 and spans(3)[0][1] >= 100
    assert spans(5) == [(0, 60)]
    left = {r.doc_id: r.text for r in substrings.without_spans(df, result).collect()}
    assert left[2].split() == texts[2].split()[70:] and left[5].split() == texts[5].split()[60:] and left[0] == texts[0] and left[7] is None
    assert substrings.repeated_passages(df.limit(0)).count() == 0


def held(spans, start, end):
    """One span; a word beside the passage may be equal by chance."""
    return len(spans) == 1 and start - 2 <= spans[0][0] <= start and end <= spans[0][1] <= end + 2


def test_passages_that_the_first_holder_of_their_shingles_lacks(spark):
    rng = random.Random(8)
    rows, n = [], 60
    for k in range(n):
        passage = text_of(rng, 60)
        part = " ".join(passage.split()[10:50])  # 40 words: too few to repeat, enough to hold the smallest shingles
        near = " ".join("edited" if i == 30 else w for i, w in enumerate(passage.split()))
        for i, p in enumerate((part, passage, passage, near)):
            rows.append((i * n + k, text_of(rng, 40) + " " + p + " " + text_of(rng, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in substrings.repeated_passages(df).collect()}
    assert all(got[k] == [] for k in range(2 * n))
    assert all(held(got[k], 40, 100) for k in range(2 * n, 4 * n))


def test_broadcasts_are_bounded_by_their_bytes(spark):
    marked = lambda df, **most: "Hint" in few(df, **most)._jdf.queryExecution().logical().toString()
    ids = spark.range(1000)
    assert marked(ids) and marked(ids, most=1000 * 64) and not marked(ids, most=1000 * 64 - 1)
    assert not marked(spark.range(1_300_000))  # 79 MB
    span = F.struct(F.lit(1).alias("start"), F.lit(2).alias("end"))
    for c in (F.expr("repeat('x', 100000)"), F.array_repeat(span, 10000), F.array_repeat(F.lit("word"), 10000), F.array_repeat(F.lit(1), 20000)):
        assert not marked(ids.select("id", c.alias("c"))) and marked(ids.limit(9).select("id", c.alias("c")))
    assert marked(ids.select("id", F.lit(None).cast("array<int>").alias("c"), F.lit(None).cast("string").alias("s")))


def test_passages_without_broadcasts(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(map(str, substrings.repeated_passages(df).collect()))
    monkeypatch.setattr(common, "FEW_BYTES", 0)
    assert sorted(map(str, substrings.repeated_passages(df).collect())) == want


def test_shared_cells_by_brute_force(monkeypatch):
    """Cells go to parts of hashes in few bytes, one of a strip's for a hash that many documents have, and none is lost."""
    monkeypatch.setattr(substrings, "KNOWN", 50)
    rng, parts = np.random.default_rng(1), 5
    pool, of, docs = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2), {}, []
    for d in range(300):
        p = np.sort(rng.choice(200, int(rng.integers(1, 30)), replace=False)).astype(np.uint32)
        u = rng.choice(pool, len(p)) if d % 3 else rng.integers(0, 1 << 63, len(p)).astype(np.uint64)
        u[0] = pool[0]  # all have it
        docs.append((f"d{d}", p, u))
        for x in u.tolist():
            of.setdefault(x, set()).add(f"d{d}")
    strips = []
    for s in range(0, len(docs), 37):
        ids, p, u = zip(*docs[s : s + 37], strict=True)
        number = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(x) for x in u])
        strips.append(substrings.strip(pa.array(ids), number, np.concatenate(p), np.concatenate(u), parts))
    rows = pa.Table.from_batches(strips).sort_by("part").combine_chunks()
    marked = [(i, m) for b in substrings.shared_cells(iter(rows.to_batches())) for i, ms in zip(*(c.to_pylist() for c in b.columns), strict=True) for m in ms]
    assert len(marked) == len(set(marked))
    assert set(marked) == {(i, q) for i, p, u in docs for q, x in zip(p.tolist(), u.tolist(), strict=True) if len(of[x]) > 1}
    hot = int(pool[0] >> np.uint64(32)) * parts >> 32
    dealt = rows.filter(pa.array([x == hot and not k for x, k in zip(rows["part"].to_pylist(), rows["known"].to_pylist(), strict=True)]))
    keys = [np.cumsum(substrings._decoded(c, n, np.uint64, np.uint32, np.uint32)[0]) for c, n in zip(dealt["cells"].to_pylist(), dealt["n"].to_pylist(), strict=True)]
    assert sum(int((k == pool[0]).sum()) for k in keys) == len(strips)
    u = np.sort(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))
    code = substrings._coded(np.diff(u, prepend=np.uint64(0)), rng.integers(0, 900, len(u)).astype(np.uint32), rng.integers(0, 500, len(u)).astype(np.uint32))
    assert len(code) < 10 * len(u)  # rows of Spark took 17 bytes a cell, twice


def test_shared_cells_make_a_row_a_document():
    """However many parts cells are dealt to, a document's marks are one row, and a part answers each row with one."""
    rng, pool = np.random.default_rng(2), np.random.default_rng(3).integers(0, 1 << 63, 900).astype(np.uint64) * np.uint64(2)
    docs = [(d, np.arange(40, dtype=np.uint32), rng.choice(pool, 40, replace=False)) for d in range(200)]
    of = np.unique(np.concatenate([u for *_, u in docs]), return_counts=True)
    want = {(d, q) for d, p, u in docs for q, x in zip(p.tolist(), u, strict=True) if of[1][np.searchsorted(of[0], x)] > 1}
    for parts in (1, 5, 40):
        strips = []
        for s in range(0, len(docs), 50):
            ids, p, u = zip(*docs[s : s + 50], strict=True)
            strips.append(substrings.strip(pa.array(ids), np.repeat(np.arange(50, dtype=np.uint32), 40), np.concatenate(p), np.concatenate(u), parts))
        rows = pa.Table.from_batches(strips).sort_by("part").combine_chunks()
        made = [(i, m) for b in substrings.shared_cells(iter(rows.to_batches())) for i, m in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert len(made) == len({i for i, _ in made}) == len(docs)  # a row a document and part before
        assert {(i, q) for i, m in made for q in m} == want
        assert sum(len(x) for x in rows["ids"].to_pylist() if x) == len(docs)  # ids go once, too
        back = pa.Table.from_batches(substrings.answered(iter(rows.to_batches())))
        assert len(back) == len(rows) and pc.all(back["known"]).as_py()
        back = back.sort_by("strip").combine_chunks()
        assert {(i, q) for b in substrings.shared_cells(iter(back.to_batches())) for i, m in zip(*(c.to_pylist() for c in b.columns), strict=True) for q in m} == want
        with pytest.raises(ValueError, match="missing"):
            list(substrings.shared_cells(iter(back.slice(1).to_batches())))
    alone = substrings.strip(pa.array(["x"]), np.zeros(3, np.uint32), np.arange(3, dtype=np.uint32), pool[:3], 2)
    assert sum(b.num_rows for b in substrings.shared_cells(iter([alone]))) == 0


def test_repeated_spans_by_brute_force():
    rng = random.Random(31)
    for _ in range(30):
        a = [rng.choice(WORDS).encode() for _ in range(rng.choice([20, 90, 160]))]
        b = [rng.choice(WORDS).encode() for _ in range(120)]
        if rng.random() < 0.8:
            n, at = rng.choice([30, 49, 50, 70]), rng.randrange(40)
            a[10 : 10 + n] = b[at : at + n]
        runs = {tuple(b[k : k + 50]) for k in range(len(b) - 49)}
        want = {k + j for k in range(len(a) - 49) if tuple(a[k : k + 50]) in runs for j in range(50)}
        assert {k for s, e in substrings.repeated_spans(a, b, least=1.01) for k in range(s, e)} == want


def test_texts_that_are_staged_move_once_and_compressed(spark):
    from tidewire.llm.common import Staged

    for text in ("", "é ü 漢字", "the same words " * 500):
        assert substrings.unpacked(substrings.packed(text)) == text.encode()
    assert len(substrings.packed("the same words " * 500)) < 200
    staged = Staged(spark.range(1000).selectExpr("id", "repeat('x', 100) AS text"), bucket="id")
    other = spark.range(0, 1000, 7).selectExpr("id", "id * 2 AS n")
    joined = staged.df.hint("merge").join(other, "id")
    assert joined.count() == 143
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.split("+- == Initial Plan ==")[0].count("Exchange hashpartitioning") == 1  # of the other rows
    staged.drop()
    assert not spark.catalog.tableExists(staged.name)


def test_passages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.id: {k for s in r.spans for k in range(s.start, s.end)} for r in substrings.repeated_passages(docs).collect()}
    first, want = {}, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = (r.text or "").encode().split()
        keys = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        want[r.doc_id] = {k + j for k, x in enumerate(keys) if first.get(x, r.doc_id) < r.doc_id for j in range(50)}
        for x in keys:
            first.setdefault(x, r.doc_id)
    assert sum(map(len, want.values())) > 100
    assert all(want[k] <= got[k] for k in want)  # near passages come on top


def test_longer_passage_than_the_first_holder_has(spark):
    rng = random.Random(9)
    rows, n = [], 60
    for k in range(n):
        passage = text_of(rng, 70)
        for i, p in enumerate((" ".join(passage.split()[:60]), passage, passage)):
            rows.append((i * n + k, text_of(rng, 40) + " " + p + " " + text_of(rng, 40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [(s.start, s.end) for s in r.spans] for r in substrings.repeated_passages(df).collect()}
    assert all(held(got[n + k], 40, 100) and held(got[2 * n + k], 40, 110) for k in range(n))


def brute_top_k(rows, k, query):
    rows = [(i, [int(x) for x in np.floor(64 * np.array(v, float)).tolist()]) for i, v in rows]
    out = []
    far = topk.FARTHEST
    for n, (q, a) in enumerate(rows):
        if query(q):
            scores = sorted((-max(-far, min(far, sum(x * y for x, y in zip(a, b, strict=False)))), c) for m, (c, b) in enumerate(rows) if m != n)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 100])
def test_top_k_equals_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=6).round(1)]) for k in range(150)]
    rows += [(k, [1.0] * 6) for k in range(150, 230)]  # ties across the kth place
    rows += [*rows[:3], (20, [0.5] * 6)]  # rows of one id, equal and not
    bad = [(400, None), (420, [1.0, None]), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (None, [1.0] * 6), (480, [])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows + bad], "vec_id long, embedding array<float>, score string").repartition(5)
    got = topk.top_k(df, 7, F.col("vec_id") % 20 == 0, block=block).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top_k([(k, np.float32(v)) for k, v in rows], 7, lambda q: q % 20 == 0)
    few = df.where("vec_id in (1, 2, 40)")
    assert len(topk.top_k(few, 7, F.col("vec_id") % 20 == 0).collect()) == 4
    assert topk.top_k(df.limit(0), 7, F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(40)]
    rows += [(40, [1e200, 0.0, 0.0, -3.0]), (41, [-1e200, 1.0, 0.0, 0.0]), (42, [3e9, 1e9, 0.5, 0.0]), (43, [3e9, -9e9, 0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, 6, F.col("vec_id") % 4 == 0).collect()
    assert sorted(map(tuple, got)) == brute_top_k(rows, 6, lambda q: q % 4 == 0)


def water_fill(sizes, weights):
    share, open_, out = 1.5 * sum(sizes.values()), dict(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if share * weights[s] / total > 2 * sizes[s]]
        if not full:
            return out | {s: share * weights[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            share -= out[s]
            del open_[s]
    return out


def test_mixing(spark):
    rng = random.Random(6)
    rows = [(k, text_of(rng, rng.randrange(0, 60)), rng.choice(["b", "a", "z", None, "é", "Z", "rare"][: 7 if k % 50 == 0 else 6])) for k in range(900)]
    rows += [(None, "no key here", "a"), (7, None, "b"), rows[3], rows[3], (1000, "   ", "only blanks")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.plan_mix(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(df.repartition(7)).collect()))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
        assert len(r.shards) == -(-r.taken // r.size) if r.size else True
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert mixing.plan_mix(df.limit(0)).count() == 0
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and abs(sum(len((r.text or "").split()) for r in mixed.collect()) - sum(want.values())) < 200


def test_splitting_tree_keeps_quotas():
    q = np.array([100, 0, 7, 3000])
    source = np.repeat(np.arange(4), q)
    index = np.concatenate([np.arange(n) for n in q])
    shard = mixing.SplittingTree(q, 10, 3).shards_of(source, index)
    one_by_one = mixing.SplittingTree(q, 10, 3)
    assert all(one_by_one.shards_of(source[k : k + 1], index[k : k + 1])[0] == shard[k] for k in range(0, len(shard), 37))
    counts = np.bincount(shard, minlength=10)
    assert counts.min() >= 310 and np.ptp(counts) <= 2
    assert all((np.diff(shard[source == k]) >= 0).all() for k in range(4))  # runs of each source's permutation
    drawn = [mixing._drawn(np.random.default_rng(k), 600, 400, 100) for k in range(400)]
    assert abs(np.mean(drawn) - 60) < 1 and 4 < np.std(drawn) < 5.5


def test_blocks_grow_where_there_would_be_too_many(spark, monkeypatch):
    """Every draw stays one that the library makes exactly: larger blocks, the same words of each source."""
    rng = random.Random(17)
    df = spark.createDataFrame([(k, text_of(rng, rng.randrange(1, 40)), "abc"[k % 3]) for k in range(2000)], "doc_id long, text string, source string")
    taken = lambda: {r.source: r.n for r in mixing.plan_mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    before = taken()
    asked = []
    whole = mixing._drawn
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 20)
    monkeypatch.setattr(mixing, "_drawn", lambda rng, good, bad, take: asked.append(good + bad) or whole(rng, good, bad, take))
    assert taken() == before


def test_mix_loses_no_row_for_its_nulls(spark):
    rows = [(1, "one two", "en", None), (1, "one two", None, "en"), (None, "one two", "en", None), (1, None, "en", "one two"), (1, "one two", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = Counter(map(tuple, mixing.mix(df).collect()))
    assert set(got) == set(rows) and max(got.values()) <= 2  # the words of every source are taken once at least
    assert {r for r in got if r[2] is None} == {rows[1]}  # the only row of its source


def test_passages_of_rows_that_share_an_id(spark):
    rng = random.Random(31)
    p, q, a, b = text_of(rng, 60), text_of(rng, 70), text_of(rng, 30), text_of(rng, 21)
    rows = [(1, p), (5, f"{a} {p}"), (5, b), (5, q), (6, f"{b} {q}"), (5, q), (None, p), (None, None), (7, None), (7, "")]
    df = spark.createDataFrame([(k, t, "x", 3) for k, t in rows], "doc_id long, text string, id string, document int")
    got = sorted((r.id is None, r.id or 0, r.n_words, [tuple(s) for s in r.spans], r.n_repeated, r.sources) for r in substrings.repeated_passages(df).collect())
    assert got == sorted([
        (False, 1, 60, [], 0, []), (False, 5, 90, [(30, 90)], 60, [1]), (False, 5, 21, [], 0, []), (False, 5, 70, [], 0, []), (False, 5, 70, [], 0, []),
        (False, 6, 91, [(21, 91)], 70, [5]), (False, 7, 0, [], 0, []), (False, 7, 0, [], 0, []), (True, 0, 0, [], 0, []), (True, 0, 60, [], 0, []),
    ])


def test_shards_are_partitions(spark):
    rng = random.Random(16)
    df = spark.createDataFrame([(k, text_of(rng, 30), "ab"[k % 7 == 0]) for k in range(9000)], "doc_id long, text string, source string")
    sizes = [n for n in mixing.mix(df, shards=12).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]
    assert len(sizes) == 12 and max(sizes) <= 1.6 * min(sizes)


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Where is the harbour?\nAnd is it open?"),
        (1, 1, "assistant", "It is  in the north."),
        (1, 2, "user", "Something else: who owns the boat?"),
        (1, 3, "assistant", "> it is in THE north.\n> > Where is the harbour?\nSo it is far."),
        (1, 4, "user", ">> And is it open?\nYes, until nine."),
        (1, 5, "user", "> so it is far.\nToo far."),
        (1, 6, "user", "> nobody said this\nHm."),
        (2, 0, None, None), (2, None, "user", "no turn"), (None, 1, "user", "> It is in the north.\nx"), (2, 0, None, None), (3, 0, "user", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, position string")
    got = quotes.conversations(df).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert {t: one[t].reply_to for t in one} == {0: None, 1: None, 2: None, 3: 1, 4: 0, 5: 3, 6: None}
    assert one[5].root_turn == 1 and one[3].text == "So it is far."
    assert [t for t in sorted(one, key=lambda t: one[t].position)] == [0, 4, 1, 3, 5, 2, 6]
    assert one[0].message == "<|user|>\nWhere is the harbour?\nAnd is it open?\n<|end|>\n"
    assert sorted(r.position for r in got if r.conv_id == 2) == [1, 2, 3]
    assert quotes.conversations(df.limit(0)).count() == 0


def test_quotations_that_are_wrapped_anew_or_of_an_unknown_level(spark):
    first = "The harbour opens at nine\nand closes late.\n\nTickets are sold\nat the gate."
    rows = [
        (1, 1, "user", first), (1, 2, "user", "> The harbour opens\n> at nine and closes\n> late.\nSure?"),
        (1, 3, "user", "> The harbour opens at\n> nine and closes late.\n>\n> Tickets are\n> sold at the gate.\nAll of it."),
        (1, 4, "user", "> nobody wrote this\n>> Tickets are sold at\n>> the gate.\nWell."),
    ]
    got = {r.turn: r.reply_to for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: 1}


def test_long_conversation_has_gapless_positions(spark):
    df = spark.range(1000).selectExpr("5L as conv_id", "id as turn", "'user' as role", "concat('m ', id) as text")
    assert [r.position for r in quotes.conversations(df).orderBy("turn").collect()] == list(range(1, 1001))


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf_dir)
    got = rows.collect()
    assert all(r.round_trip for r in got) and {"doc_id", "ids", "n_tokens"} <= set(rows.columns)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(3).union(docs.limit(1).withColumn("text", F.lit("12 34"))).union(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    assert corpus_pipeline.identify_language(spark, odd, sf_dir).count() == 3
    two = docs.limit(2).cache()
    assert corpus_pipeline.drop_near_duplicates(spark, two.union(two).union(two.withColumn("doc_id", F.col("doc_id") + 50)), sf_dir).count() == 2


def test_queries_match_their_sql(spark, sf_dir):
    import duckdb

    from tidewire.llm import queries

    con = duckdb.connect()
    for name in ("embeddings", "conversations", "documents", "labels"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        got = queries.QUERIES[name](spark, sf_dir)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        assert sorted(map(str, got.select(*names).collect())) == sorted(str(spark_row(names, r)) for r in want.fetchall())


def spark_row(names, values):
    from pyspark.sql import Row

    return Row(**dict(zip(names, values, strict=True)))


def test_links_across_components_of_a_bucket():
    rng = random.Random(8)
    base = text_of(rng, 150).split()
    texts = [base] + [[("x" + str(k * 7 + e)) if j in (20 + 11 * k % 90, 130) else w for j, w in enumerate(base)] for k, e in ((a, 0) for a in range(9))]
    texts += [text_of(rng, 150).split() for _ in range(4)]
    coded = [[w.encode() for w in t] for t in texts]
    labels = np.arange(len(coded))
    links = minhash.exact_links(coded, labels, 0.8)
    want = {(a, b) for a in range(len(coded)) for b in range(a + 1, len(coded)) if minhash.weighted_jaccard(coded[a], coded[b]) >= 0.8}
    assert set(links) <= want
    root = list(range(len(coded)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in want:
        root[find(a)] = find(b)
    joined = {frozenset(k for k in range(len(coded)) if find(k) == find(x)) for x in range(len(coded))}
    root = list(range(len(coded)))
    for a, b in links:
        root[find(a)] = find(b)
    assert joined == {frozenset(k for k in range(len(coded)) if find(k) == find(x)) for x in range(len(coded))}
    sigs = np.stack([np.frombuffer(minhash.band_keys(c)[1], np.uint8) for c in coded])
    assert minhash.alike(sigs, labels, 0.68)[:10].all() and not minhash.alike(sigs, labels, 0.68)[10:].any()
    assert not minhash.alike(sigs, labels * 0, 0.68).any()


def odd_documents(spark, rng):
    """Rows with equal ids, without ids, without texts, repeated, very long, and with columns of clashing names."""
    w, u, long_, own = text_of(rng, 80), text_of(rng, 90), text_of(rng, 30000), text_of(rng, 40)
    rows = [
        (3, w), (5, w), (5, u), (None, own), (None, own), (None, None), (2, ""), (2, " "), (7, long_), (7, long_), (8, "12 34"), (None, w + " but not quite"),
    ]
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string, size int, id string, sig int"
    return spark.createDataFrame([(*r, "en", None, len(r[1] or ""), "own", 7, "x", 1) for r in rows], columns), (w, u, long_, own)


def test_language_stage_rejects_what_was_not_learned(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    strange = ["这是一个中文句子，关于新闻和政治的报道。" * 3, "Αυτό είναι ένα κείμενο στα ελληνικά", "Это русский текст о новостях", "qwzx jkvv zzkq " * 4, "½ ② Ⅷ 12", None, "", "日本"]
    more = spark.createDataFrame([(10**9 + k, t, None, "s", 1) for k, t in enumerate(strange)], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(more), sf_dir).collect()}
    assert got == {r.doc_id for r in docs.collect() if r.text and any(map(str.isalpha, r.text))}
    assert len(got) > 0.95 * docs.count()


def test_keys_of_rows_see_nulls(spark):
    import corpus_pipeline

    rows = [(1, "t", "en", None, 1), (1, "t", None, "en", 1), (2, "t", None, None, 1), (None, "t", None, None, 1), (None, "t", None, None, None)]
    got = corpus_pipeline.keyed(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).collect()
    assert len({r["__key"] for r in got}) == 5 and [r["__key"] for r in got if r["__alone"]] == [2]


def test_near_duplicates_of_rows_with_equal_ids(spark, sf_dir):
    import corpus_pipeline

    docs, (w, u, long_, own) = odd_documents(spark, random.Random(21))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns
    texts = Counter(r.text for r in got.collect())
    assert sum(n for t, n in texts.items() if t and t.startswith(w)) == 1
    assert texts[u] == 1 and texts[long_] == 1 and texts[own] == 1
    assert texts[None] == 1 and texts[""] == 1 and texts[" "] == 1 and texts["12 34"] == 1
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), sf_dir).count() == 0


def test_cuts_of_rows_with_equal_ids(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(22)
    p, a, b, c = text_of(rng, 60), text_of(rng, 30), text_of(rng, 70), text_of(rng, 3)
    columns = "doc_id long, text string, n_chars int, score string"
    rows = [(1, p), (5, f"{a} {p}"), (5, b), (6, c), (None, f"{c} {p} {a}"), (None, None), (9, ""), (9, p)]
    docs = spark.createDataFrame([(*r, 0, "own") for r in rows], columns)
    got = corpus_pipeline.cut_repeated_passages(spark, docs, sf_dir)
    assert got.columns == docs.columns
    found = [(r.doc_id, r.text, r.n_chars) for r in got.collect()]
    assert all(n == len(t) and t.strip() for _, t, n in found)
    assert sum(p in t for _, t, _ in found) == 1  # one row holds the passage
    assert sorted(t.replace(p, "").split() for _, t, _ in found if t != p) == sorted(x.split() for x in (a, b, c, f"{c} {a}"))
    assert corpus_pipeline.cut_repeated_passages(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_stages_take_odd_rows(spark, sf_dir):
    import corpus_pipeline

    docs, (w, u, long_, own) = odd_documents(spark, random.Random(23))
    first = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert first.columns == docs.columns
    said = [r.text for r in docs.collect() if r.text and any(map(str.isalpha, r.text))]
    assert sorted(r.text for r in first.collect()) == sorted(said)  # a model of these texts knows them all
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    copies = Counter(r.text for r in mixed.collect())
    assert set(copies) <= {r.text for r in docs.collect()}
    plan = mixing.plan_mix(docs.distinct()).select("id", "size", "taken").collect()
    whole = sum(round(r.taken / r.size) * r.size for r in plan if r.size)
    assert sum(len((t or "").split()) * n for t, n in copies.items()) == pytest.approx(whole, abs=max(r.size for r in plan))
    coded = corpus_pipeline.encode_pieces(spark, docs, sf_dir).collect()
    assert len(coded) == docs.count() and all(r.round_trip for r in coded)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
