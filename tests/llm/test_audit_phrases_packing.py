"""Filter audit, collocations and packing: edge cases, and against brute force."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from tidewire.llm import collocations, filter_audit, packing, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, n string, key string, part string, id string, row string, place string"
LONG = "aa bb cc. " * 20_000
ODD = [
    (1, "", "en"), (2, None, "en"), (3, LONG, "de"), (4, LONG, "de"), (4, LONG, "de"), (None, LONG, None), (None, None, None), (5, "A B#", ""),
    (6, "日本語 <|endoftext|> It's\x1c \x0b x y é ́z", None), (7, "aa bb " * 150 + "! aa", "de"), (8, "\x00\x01 a\x01 b", "en"), (3, "other", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *"zzzzzz") for r in ODD], SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def against_sql(spark, name, sf_dir, views=()):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    return rows_of(got.select(*names)), sorted(map(tuple, want.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_collocations"])
def test_queries_equal_their_sql(spark, name):
    got, want = against_sql(spark, name, "/root/testdata/sf0.01")
    assert got and got == want


def audit_by_hand(docs, labels):
    """Every order run over every row."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    ids = defaultdict(list)
    for k, text, _ in docs:
        if k is not None:
            ids[text or ""].append(k)
    rows = []
    for k, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": k is not None and min(ids[text]) < k}
        rows.append((lang or "", {f for f in fails if fails[f]}, k in good, k in toxic))
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                alive = [r for r in own if not r[1] & set(order[: step - 1])]
                gone = [r for r in alive if f in r[1]]
                shapley[part, f] += len(gone)
                out.append((part, "".join(order), step, len(alive) - len(gone), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return [(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out]


def test_audit_of_odd_rows(spark, odd):
    labels = [(1, 1, 0), (1, 0, 1), (4, None, 1), (None, 1, 1), (3, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = filter_audit.flag_counts(odd, marks)
    assert rows_of(filter_audit.audit(counts)) == sorted(audit_by_hand(ODD, labels), key=repr)
    whole = filter_audit.survivors(counts).where("part is null and subset = 0").first()
    assert whole.n == len(ODD)
    assert filter_audit.audit(filter_audit.flag_counts(odd.limit(0), marks.limit(0))).count() == 0
    with pytest.raises(ValueError):
        filter_audit.orders(spark, "ABCDEFGH")


def phrases_by_hand(docs, least, most):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in docs:
        lang, small = "und" if lang is None else lang, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", small):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, g in f.items():
        found = {p: a for p, a in g.items() if a >= least and len(p) > 1}
        inside = {p[i:e] for p, a in found.items() for i in range(len(p)) for e in range(i + 2, len(p) + 1) if e - i < len(p) and a >= found[p[i:e]]}
        scores = []
        for p, a in found.items():
            if p not in inside:
                s, _, left, right = min((1000 * a * n[lang] // (g[p[:k]] * g[p[k:]]), k, g[p[:k]], g[p[k:]]) for k in range(1, len(p)))
                scores.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(scores)[:most], 1)]
    return sorted(out, key=repr)


def texts(seed, count=150):
    rng = np.random.default_rng(seed)
    words = [*"abcdefghij", "a\x01", "a!", "straße", "ÀB", "w" * 90, "\x1f"]
    return [(int(k), " ".join(rng.choice(words, 60, p=[0.2] + [0.8 / 15] * 15)) + ". " + "of the very same kind, " * int(rng.integers(0, 3)), ("en", "de", None)[k % 3]) for k in range(count)]


@pytest.mark.parametrize("least, most, head", [(20, 2000, 1 << 18), (20, 5, 1 << 18), (3, 40, 4), (20, 2000, 0)])
def test_phrases_equal_brute_force(spark, monkeypatch, least, most, head):
    """With every word held by workers, few, or none; runs and blocks of small sizes; ranges that cut phrases."""
    for name, value in (("RUN_KEYS", 700), ("MOST_WORDS", 9), ("BLOCK_BYTES", 2000), ("RANGE_ROWS", 300), ("SMALL", 0), ("SAMPLE", 0.3)):
        monkeypatch.setattr(collocations, name, value)
    docs = texts(5)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    assert rows_of(collocations.collocations(df, least=least, most=most, head_words=head)) == phrases_by_hand(docs, least, most)


def test_many_counts_are_not_broadcast(spark, monkeypatch):
    docs = texts(6)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    monkeypatch.setattr(collocations, "FEW_COUNTS", 0)
    kept, joined = collocations._joined, []
    monkeypatch.setattr(collocations, "_joined", lambda *args: joined.append(args[-1]) or kept(*args))
    assert rows_of(collocations.collocations(df, least=20)) == phrases_by_hand(docs, 20, 2000)
    assert joined and not any(joined)


def test_phrases_of_odd_rows(spark, odd):
    assert rows_of(collocations.collocations(odd)) == phrases_by_hand(ODD, 100, 2000)
    assert rows_of(collocations.collocations(odd, least=2)) == phrases_by_hand(ODD, 2, 2000)
    assert collocations.collocations(odd.limit(0)).collect() == []


def test_scores_past_64_bits(spark):
    a, n, right = 4_000_000_000_001, 9_000_000_000_000_007, 7_000_000_000_003
    phrases = spark.createDataFrame([(bytearray([1, 2]), a)], "phrase binary, a long")
    words = spark.createDataFrame([(bytearray([1]), "en", n, a + 5), (bytearray([2]), "en", n, right)], "word_key binary, lang string, total long, n long")
    for is_few in (True, False):
        row = collocations.scored(phrases, words, 1, is_few).first()
        assert (row.score, row.l, row.r, row.n) == (1000 * a * n // ((a + 5) * right), a + 5, right, n)


def test_strips_of_keys_are_small_and_merge_in_order():
    rng = np.random.default_rng(3)
    keys = collocations.Keys(40_000, 2, [])
    runs = [np.minimum(rng.zipf(1.3, 60_000), 40_000).astype(np.uint32) for _ in range(2)]
    strips = []
    for ids in runs:
        keys.add(ids)
        strips.append(keys.counted())
    assert strips[0].schema.names == ["part", "keys"] and sum(len(k) for b in strips for k in b.column("keys").to_pylist()) < 8 * 120_000
    got = [(k, n) for b in collocations.merged(2)(iter(strips)) for k, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist())]
    padded = [np.append(ids, np.zeros(4, np.uint32)) for ids in runs]
    want = [Counter(b"".join(int(x).to_bytes(2, "big") for x in p[i : i + 5]) for i in range(59_999)) for p in padded]
    assert [k for k, _ in got] == sorted(k for k, _ in got) and len(got) == len(want[0]) + len(want[1])
    total = Counter()
    for k, n in got:
        total[k] += n
    assert total == want[0] + want[1]


def test_radix_order_and_run_lengths():
    rng = np.random.default_rng(3)
    columns = [rng.integers(0, top, 5000).astype(np.uint32) for top in (3, 2, 200_000, 70_000, 4)]
    assert radix_equal(columns, 200_000)
    whole = np.stack([rng.integers(1, 4, 4000) for _ in range(5)], 1).astype(np.uint8)
    whole[rng.random(4000) < 0.3, 3:] = 0
    whole = whole[np.lexsort(whole.T[::-1])]
    import pyarrow as pa

    want = Counter(bytes(r[:m]) for r in whole for m in range(2, 6) if r[m - 1])
    for size in (1, 7, 900, 5000):  # batches cut runs; so do two ranges
        got = Counter()
        for part in (whole[:1777], whole[1777:]):
            batches = [pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in part[i : i + size]], pa.binary()), pa.array([1] * len(part[i : i + size]))], ["key", "n"]) for i in range(0, len(part), size)]
            for b in collocations.run_lengths(1, 60)(iter(batches)):
                for k, n in zip(*(c.to_pylist() for c in b.columns)):
                    got[k] += n
        assert {k: n for k, n in got.items() if n >= 60} == {k: n for k, n in want.items() if n >= 60}


def radix_equal(columns, largest):
    order = collocations.radix_order(columns, largest)
    return np.array_equal(order, np.lexsort(columns[::-1]))


def check_pieces(pieces, docs, length=2048):
    """Pieces hold each document's ids once, sequences are full but for powers of two at the end, offsets leave no gap."""
    library = tokenizers.Tokenizer.from_str(packing.tokenizer_file())
    want = Counter((k, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for k, t in docs)
    by_place = sorted(pieces, key=lambda r: (r.sequence_id, r.offset))
    ends, got, open_ids = Counter(), Counter(), b""
    for r in by_place:
        assert r.offset == ends[r.sequence_id] and r.length == len(r.ids) // 4 > 0
        ends[r.sequence_id] += r.length
        assert r.start == len(open_ids) // 4  # a document's pieces come one after the other
        open_ids += r.ids
        if r.start + r.length == r.doc_tokens:
            got[r.doc_id, open_ids] += 1
            open_ids = b""
    assert got == want
    sizes = [ends[k] for k in range(len(ends))]
    full, rest = divmod(sum(sizes), length)
    assert sizes == [length] * full + [1 << b for b in range(20, -1, -1) if rest >> b & 1]


def test_packing_holds_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack(docs).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()])
    lang = {r.doc_id: r.lang for r in docs.collect()}
    near = [lang[r.doc_id] for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]
    share = sum(Counter(lang.values())[x] ** 2 for x in set(lang.values())) / len(lang) ** 2
    assert np.mean([a == b for a, b in zip(near, near[1:])]) > share + 0.2  # neighbours on the curve are alike


def test_packing_of_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_IDS", 500)
    docs = [(k, t) for k, t, _ in ODD]
    pieces = packing.pack(odd)
    check_pieces(pieces.collect(), docs)
    check_pieces(packing.pack(odd, length=16).collect(), docs, 16)
    assert packing.pack(odd.limit(0)).count() == 0
    made = {r.sequence_id: r for r in packing.sequences(pieces).collect()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in made.values()) and made[0].n_tokens == 2048
    with pytest.raises(ValueError):
        packing.pack(odd, length=100)
    with pytest.raises(ValueError):
        packing.Encoder(open(__import__("public_tokenizers").path("byte_bpe_50k.json")).read())


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        place = packing.hilbert(grid, bits)
        assert sorted(place.tolist()) == list(range(len(grid)))
        steps = np.abs(np.diff(grid[np.argsort(place)], axis=0))
        assert (steps.sum(1) == 1).all()


def test_cells_are_in_bounds():
    points = np.array([[1e300, -1e300, 0.0, np.inf], [0.0, 0.0, 0.0, -np.inf]])
    got = packing.cells(points, np.zeros(4), np.zeros(4))
    assert got.min() >= 0 and got.max() < 1 << packing.BITS


def test_hot_copies_are_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text that all rows share").alias("text"))
    pieces = packing.pack(df)
    assert pieces.select(F.spark_partition_id().alias("p")).distinct().count() >= 3 and pieces.agg(F.sum("length")).first()[0] == 3000 * 7
