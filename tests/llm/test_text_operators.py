"""Encoding, token counts, fertility rules, language and toxicity on edge cases and against brute force."""

import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sp = pytest.importorskip("sentencepiece")
from pyspark.sql import functions as F  # noqa: E402

from tidewire.llm import fertility, language_id, pieces, sentence_pieces, token_counts, toxicity  # noqa: E402

ODD = [
    "", " ", "  a  b ", "\n\n", "日本語のテキスト、これは。" * 9, "▁a ▁▁ b", "😀 x<s></s><unk> <0x0A>", "a" * 700, "\x00 x",
    "    def f(x):\n        return x\n" * 9, "Ωμέγα слово " * 9, "ab\tcd\r\n", "the quick brown fox " * 3000,
]
SCHEMA = "doc_id long, text string, ids string, score string, lang string, n_tokens string"


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.model_bytes()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", None, "en", "y") for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, (None, "no id", None, None, None, None), (99, None, None, None, None, None), rows[2], rows[2]], SCHEMA)


def test_ids_and_counts_equal_the_library(model, spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(80).collect()] + ODD
    library = sp.SentencePieceProcessor(model_proto=model)
    encoder, counter = pieces.Encoder(model), pieces.Encoder(model, counted=True)
    wanted = [library.encode(t) for t in texts]
    ids, bounds = encoder.batch(texts)
    assert [ids[a:e].tolist() for a, e in zip(bounds, bounds[1:])] == wanted
    assert counter.counts(texts).tolist() == [len(w) for w in wanted]
    assert encoder.decoded(ids, bounds) == [t.replace("▁", " ").encode() for t in texts]
    assert encoder.machine.chunks > 200 and counter.machine.chunks > 200  # texts pass through chunk maps
    assert encoder.batch([]) [0].size == 0 and counter.counts([]).size == 0 and counter.counts([None, ""]).tolist() == [0, 0]


def test_chunks_that_guess_wrongly(model, monkeypatch):
    """Texts without a space: a chunk's first state can't be told from the bytes before it."""
    monkeypatch.setattr(pieces, "CHUNK", 40)
    monkeypatch.setattr(pieces, "BLOCK", 400)
    monkeypatch.setattr(pieces, "AHEAD", 3)
    library, rng = sp.SentencePieceProcessor(model_proto=model), np.random.default_rng(7)
    texts = ["a" * 3001, "日本" * 900, "the" * 700 + "a" * 90, "".join(rng.choice(list("aetßé 日x☃"), 4000)), "", " " * 333, "".join(rng.choice(list("ab"), 3000))]
    encoder, counter = pieces.Encoder(model), pieces.Encoder(model, counted=True)
    for t in texts:
        assert encoder.encode(t) == library.encode(t) and counter.counts([t]).tolist() == [len(library.encode(t))]
    assert counter.counts(texts).tolist() == [len(library.encode(t)) for t in texts]


def test_bounded_memory_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_PAIRS", 10)
    encoder, counter, library = pieces.Encoder(model, most=40), pieces.Encoder(model, counted=True, most=40), sp.SentencePieceProcessor(model_proto=model)
    for t in ODD[:12]:
        assert encoder.encode(t) == library.encode(t) and counter.counts([t])[0] == len(library.encode(t))
    assert len(encoder.machine.keys) < 2000


def test_states_take_few_bytes(model):
    """A worker holds some 300,000 states; as tuples of numbers they took 250 bytes each."""
    encoder, counter = pieces.Encoder(model), pieces.Encoder(model, counted=True)
    for e in (encoder, counter):
        e.batch(ODD) if e is encoder else e.counts(ODD)
        held, names = e.machine.keys, e.machine.names(np.arange(len(e.machine.keys)) << 8)
        assert len(set(names)) == len(held) > 100 and e.machine.states(names).tolist() == [k << 8 for k in range(len(held))]
        assert sum(map(sys.getsizeof, held)) < 120 * len(held) and all(isinstance(k, bytes) for k in held)


def test_unigram_lattice_is_the_best_sum(model):
    encoder = pieces.Encoder(model, "unigram")
    v = encoder.v
    worst = min(v.scores) - 10.0
    for plain in ["thing", "ΩAblethings", "internationalisation" * 8]:
        text = "▁" + plain
        best = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - v.longest), e):
                i = v.ids.get(text[s:e])
                if i is not None or e - s == 1:
                    best[e] = max(best[e], best[s] + (worst if i is None else v.scores[i]))
        total, seen = 0.0, encoder.encode(plain)
        assert encoder.decode(seen) == plain
        k = 0
        while k < len(seen):
            if v.is_byte[seen[k]]:
                k += 2  # a two-byte character outside the vocabulary
                total += worst
            else:
                total += v.scores[seen[k]]
                k += 1
        assert total == pytest.approx(best[-1])


def test_encode_decode_frames(docs, model):
    coded = sentence_pieces.decode(sentence_pieces.encode(docs, model), model, out="back")
    assert coded.columns == ["doc_id", "text", "score", "lang", "n_tokens", "ids", "back"]
    for r in coded.collect():
        assert r.back == (r.text or "").replace("▁", " ")
    checked = sentence_pieces.encode(docs, model, check="score")
    assert checked.columns == ["doc_id", "text", "lang", "n_tokens", "ids", "score"] and all(r.score for r in checked.collect())
    got = sentence_pieces.round_trip(docs, model).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    assert sentence_pieces.round_trip(docs.limit(0), model).count() == 0
    library = sp.SentencePieceProcessor(model_proto=model)
    for r in got:
        if r.doc_id is not None and r.doc_id < len(ODD):
            assert r.ids_crc32 == zlib.crc32(np.array(library.encode(ODD[r.doc_id]), "<i4").tobytes())


def test_token_counts(docs, model):
    rows = token_counts.token_counts(docs, model, limit=1000).collect()
    assert len(rows) == docs.count()
    library = sp.SentencePieceProcessor(model_proto=model)
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(ODD):
            t = ODD[r.doc_id]
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 1000)
    assert token_counts.token_counts(docs.limit(0), model).count() == 0


def test_repeated_words_by_brute_force():
    rng = np.random.default_rng(3)
    for n in [0, 7, 8, 9, 40, 200]:
        for vocabulary in (1, 2, 9):
            w = [b"w%d" % k for k in rng.integers(0, vocabulary, n)]
            windows = [tuple(w[k : k + 8]) for k in range(n - 7)] if n > 7 else []
            hit = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
            assert fertility.repeated_words(w) == len(hit)


def test_base_rules_by_brute_force(spark, sf_dir):
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = {w for w, n in Counter(windows).items() if n > 1}
        repeat = len({k + j for k, w in enumerate(windows) if w in often for j in range(8)})
        return (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat,
            len(words) < 20 or 100 * repeat > 30 * len(words),
        )

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + ODD
    for t in texts:
        assert fertility.base_rules(t or "") == plain(t or "")


def test_entropies():
    ids, bounds = np.array([1, 1, 2, 2, 5, 5, 5, 7]), np.array([0, 4, 4, 7, 8])
    assert fertility.entropies(ids, bounds).tolist() == [1.0, 0.0, 0.0, 0.0]
    assert fertility.entropies(np.zeros(0, np.int64), np.zeros(1, np.int64)).tolist() == []


def test_bands_reject_junk_and_keep_prose(spark, docs):
    rng, vocabularies = np.random.default_rng(11), fertility.vocabularies()
    stock = "the committee met on tuesday to discuss new rules for harbour and several members asked more time before they would vote".split()
    say = lambda n: " ".join(rng.choice(stock, n))
    prose = [(k, say(120), "en" if k % 2 else None) for k in range(400)]
    junk = [(1000 + k, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in say(120).split()), "en") for k in range(8)]
    hex_ = [(2000 + k, " ".join("%08x" % rng.integers(1 << 32) for _ in range(120)), None) for k in range(8)]
    rare = [(3000, " ".join("☃✈⚙" + chr(0x2600 + k) for k in range(120)), "xx")]
    df = spark.createDataFrame(prose + junk + hex_ + rare, "doc_id long, text string, lang string").withColumn("kept", F.lit("own"))
    got = {r.doc_id: r for r in fertility.quality_rules(df, vocabularies).collect()}
    assert sum(not got[k].kept for k in range(400)) <= 4
    assert not any(got[r[0]].kept for r in junk + hex_) and {got[r[0]].reason for r in junk} == {"chars_per_token"}
    assert not got[3000].kept  # no band, no letters, byte fallback throughout
    assert len(got[0].chars_per_token) == 2 and got[0].script == "latin"
    odd = fertility.quality_rules(docs, vocabularies).collect()
    assert len(odd) == docs.count() and all(r.base_failed and not r.kept and r.n_words == 0 for r in odd if r.doc_id == 99)
    assert all(r.kept != r.base_failed for r in odd)  # no group is large enough for a band
    assert fertility.quality_rules(docs.limit(0), vocabularies).count() == 0


def test_script():
    assert fertility.script_of("abc déf") == "latin"
    assert fertility.script_of("слово a") == "cyrillic"
    assert fertility.script_of("日本語かな") == "han"
    assert fertility.script_of("123 ...") == "none"


def test_language_held_out_and_edges(spark, docs, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(table)
    got = language_id.predict(table, model, passing=True).where("crc32(cast(doc_id as string)) % 3 = 1").collect()
    right = [r.lang_pred == r.lang for r in got]
    assert sum(right) / len(right) > 0.95
    odd = language_id.predict(docs, model).collect()
    assert len(odd) == docs.count() and {r.lang_pred for r in odd if r.doc_id in (0, 1, 3, 99)} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.train(docs.limit(0)) is None
    # the label is no input of a prediction
    blind = language_id.predict(table.withColumn("lang", F.lit("xx")), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in blind] == [r.lang_pred for r in language_id.predict(table, model).orderBy("doc_id").collect()]


def test_letters_of_all_scripts(spark, sf_dir):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = [(0, "½ ② ① Ⅷ"), (1, "٣٤ 12_3"), (2, "½ a"), (3, "日"), (4, "\u0301"), (5, "ʰ")]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), model, learned="known").collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {0, 1, 4} and not got[3].known and not got[0].known


def test_kernel_ridge_equals_the_dense_solution():
    """With every training text a landmark and hardly any penalty the features are exact: the dense weighted kernel
    ridge regression on the same texts scores alike."""
    rng = np.random.default_rng(4)
    words = {"x": ["alpha", "beta", "gamma", "delta"], "y": ["ein", "haus", "über", "strasse"], "z": ["élan", "vélo", "garçon", "forêt"]}
    made = [(" ".join(rng.choice(words[k], 6)), k) for k in words for _ in range(8 + 4 * (k == "x"))]
    texts, labels = [language_id.distinct_grams(t) for t, _ in made], [k for _, k in made]
    model = language_id.fit(texts, labels, n_landmarks=len(texts), n_grams=1 << 16, ridge=0.5)
    codes = np.unique(np.concatenate(texts))
    x = np.array([np.isin(codes, t).astype(float) for t in texts])
    x /= np.sqrt(x.sum(1, keepdims=True))
    k, y = x @ x.T, np.array([sorted(words).index(v) for v in labels])
    weight = np.diag((len(y) / 3 / np.bincount(y))[y])
    target = np.where(y[:, None] == np.arange(3), 1.0, -1.0)
    # The minimum over f in the span of the texts of sum weight (f - target)^2 + ridge n / 100 |f|^2.
    alpha = np.linalg.solve(weight @ k + 0.5 * len(y) / 100 * np.eye(len(y)), weight @ target)
    probe = [t for t, _ in made[::3]] + ["gamma haus", "vélo ein ein"]
    scorer = language_id.Scorer(model)
    got = np.log(scorer.score(probe)) / scorer.sharpness
    at = [language_id.distinct_grams(t) for t in probe]
    p = np.array([np.isin(codes, t).astype(float) for t in at])
    p /= np.sqrt(p.sum(1, keepdims=True))
    want = p @ x.T @ alpha
    centred = lambda m: m - m.mean(1, keepdims=True)
    assert np.abs(centred(got) - centred(want)).max() < 0.02


def test_presence_kernel():
    a, b = language_id.distinct_grams("Über  Haus"), language_id.distinct_grams("über haus!")
    assert a.tolist() == b.tolist()


def test_toxicity(spark, docs):
    clean = ["the harbour opens at nine", "a report on fishing quotas", "music in the park tonight", "the council will meet again"]
    rows = [(k, clean[k % 4] + f" item {k % 13}" + (" you are a stupid idiot" if k % 7 == 0 else ""), None) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k in range(0, 400, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert all(got[k].predicted == int(k % 7 == 0) for k in range(400))
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    empty = toxicity.train(df.limit(0), labels.limit(0))
    assert toxicity.score(df, empty).count() == 400 and toxicity.score(df.limit(0), model).count() == 0


def test_label_model_finds_accuracies_and_links():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, y, ~y) * 2 - 1
    a, b = vote(0.9), vote(0.75)
    votes = np.stack([a, b, np.where(rng.random(4000) < 0.97, b, -b), vote(0.85), np.where(rng.random(4000) < 0.2, y * 2 - 1, 0)], 1).astype(np.int8)
    model = toxicity.fit_label_model(votes)
    assert [1, 2] in model.groups
    assert abs(model.accuracies[0][0] - 0.9) < 0.06 and ((model.posterior(votes) > 0.5) == y).mean() > 0.9
