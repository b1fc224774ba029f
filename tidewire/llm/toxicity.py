"""Toxicity by weak supervision.

Voters (fixed word lists, words mined from the labelled training rows, writing patterns) vote toxic, clean or abstain.
A generative label model estimates each voter's accuracy by expectation maximisation, and which voters are correlated
beyond what the label explains; correlated voters vote as one. The gold label is one more, imperfect, voter where it
is known. A linear classifier learns from the posterior labels and scores every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, remainder, slices

#: Words of insult and threat, by list.
LEXICONS = {
    "insult_en": "idiot idiots moron morons stupid dumb fool loser losers clown clowns imbecile dimwit jerk",
    "contempt_en": "pathetic worthless useless trash garbage scum filth disgusting vermin parasite",
    "threat_en": "kill murder shoot hurt destroy",
    "profane_en": "damn crap bastard bitch shit fuck fucking",
    "insult_de": "idiot trottel depp dumm dummkopf versager abschaum müll wertlos erbärmlich clown",
    "insult_fr": "idiot idiote imbécile crétin débile minable ordure déchet pathétique",
    "insult_es": "idiota imbécil estúpido tonto basura escoria inútil patético payaso perdedor",
}
_WORDS = re.compile(r"[^\W\d_]+").findall
_SHOUT = re.compile(r"!{2,}").search
_MASKED = re.compile(r"\b[a-z]+[*#$@]+[a-z]+\b", re.I).search


def stems(word: str) -> list[str]:
    """The word and its beginnings of 4 to 7 letters, which inflected and compounded forms share."""
    return [word, *(f"^{word[:k]}" for k in range(4, min(len(word), 8)))]


@dataclass
class Voters:
    lists: dict[str, frozenset[str]]
    mined: list[str]
    names: list[str] = field(init=False)

    def __post_init__(self):
        self.names = [*self.lists, *(f"word:{w}" for w in self.mined), "shout", "masked", "repeat", "no_list_word"]


@dataclass
class LabelModel:
    """Class-conditional vote tables of groups of voters; voters of a group are correlated given the label."""

    groups: list[list[int]]
    tables: list[dict[tuple, tuple[float, float]]]
    prior: float
    accuracies: list[tuple[float, float]]  # of each voter: share of votes that are right, coverage
    correlations: list[tuple[int, int, float]]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logit = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for group, t in zip(self.groups, self.tables, strict=True):
            logit += [np.log(a / b) for a, b in (t.get(tuple(v), (1.0, 1.0)) for v in votes[:, group].tolist())]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_label_model(votes: np.ndarray, rounds: int = 30, linked: float = 0.25, smooth: float = 1.0) -> LabelModel:
    """Expectation maximisation over votes (rows by voters; the last voter is the gold label, 0 where unknown)."""
    n, m = votes.shape
    gold = votes[:, -1]
    positive = (votes[:, :-1] > 0).sum(1)
    p = np.where(gold > 0, 0.85, np.where(gold < 0, 0.02, np.where(positive > 1, 0.7, np.where(positive > 0, 0.3, 0.03))))
    groups = [[k] for k in range(m)]
    correlations: list[tuple[int, int, float]] = []
    prior, tables = 0.1, []
    for step in range(rounds):
        if step in (1, rounds // 2):  # before correlated voters outvote the rest, and once accuracies have settled
            groups, correlations = _linked(votes, p, linked)
        prior = float(np.clip(p.mean(), 1e-3, 0.5))
        tables = []
        for group in groups:
            keys, at = np.unique(votes[:, group], axis=0, return_inverse=True)
            at = at.reshape(-1)
            one, zero = np.bincount(at, p, len(keys)), np.bincount(at, 1 - p, len(keys))
            one, zero = (one + smooth) / (one.sum() + smooth * len(keys)), (zero + smooth) / (zero.sum() + smooth * len(keys))
            if group == [m - 1]:  # gold labels: a strong prior of being right keeps the two classes what they are
                sure = {1: (0.9, 0.02), -1: (0.1, 0.98), 0: (1.0, 1.0)}
                one, zero = (np.array([sure[k][c] for k in keys[:, 0].tolist()]) for c in (0, 1))
            tables.append({tuple(k): (float(a), float(b)) for k, a, b in zip(keys.tolist(), one, zero, strict=True)})
        p = LabelModel(groups, tables, prior, [], []).posterior(votes)
    right = [(float((np.where(votes[:, k] > 0, p, 1 - p))[votes[:, k] != 0].mean()) if (votes[:, k] != 0).any() else 0.5, float((votes[:, k] != 0).mean())) for k in range(m)]
    return LabelModel(groups, tables, prior, right, correlations)


def _linked(votes: np.ndarray, p: np.ndarray, least: float, most: int = 4) -> tuple[list[list[int]], list[tuple[int, int, float]]]:
    """Groups of voters whose residual correlation given the label is ``least`` or more; a group has ``most`` at most."""
    m = votes.shape[1]
    cov = np.zeros((m, m))
    for w in (p, 1 - p):
        mean = (votes * w[:, None]).sum(0) / max(w.sum(), 1e-9)
        r = votes - mean
        cov += (r * w[:, None]).T @ r
    d = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    corr = cov / d / d[:, None]
    pairs = sorted(((abs(corr[i, j]), i, j) for i in range(m - 1) for j in range(i + 1, m - 1) if abs(corr[i, j]) >= least), reverse=True)
    group = {k: [k] for k in range(m)}
    for _, i, j in pairs:
        a, b = group[i], group[j]
        if a is not b and len(a) + len(b) <= most:
            a.extend(b)
            for k in b:
                group[k] = a
    return [sorted(g) for g in {id(g): g for g in group.values()}.values()], [(i, j, float(corr[i, j])) for _, i, j in pairs]


@dataclass
class Model:
    voters: Voters
    labels: LabelModel | None
    weights: dict[str, float]  # of words; bounded by ``n_features``
    patterns: np.ndarray  # of the pattern voters
    bias: float


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int) -> "Sample":
    """At most about ``most`` labelled training rows of each label and ``most`` unlabelled rows, by a hash of the key.

    Whole texts are read on the executors, which send their distinct words.
    """
    order = F.pmod(F.xxhash64(F.lit("toxicity"), F.col(key).cast("string")), F.lit(1 << 40))
    known = labels.select(F.col(key), F.col(label).cast("int").alias("__y")).where(F.col("__y").isNotNull() & F.col(key).isNotNull())
    known = known.where(remainder(key, 5) != 0).groupBy(key).agg(F.max("__y").alias("__y"))
    counts = {r[0]: r[1] for r in known.groupBy("__y").count().collect()}
    chosen = F.lit(False)
    for y, n in sorted(counts.items()):
        chosen = chosen | ((F.col("__y") == y) & (order < int((1 << 40) * min(1.0, most / n))))
    rows = docs.select(key, text).where(F.col(text).isNotNull())
    few = known.where(chosen)
    # The sample's size is bounded by ``most`` rows of each label, so its ids are too.
    labelled = rows.join(F.broadcast(few), key).select("__y", F.col(text).alias("text"), order.alias("order"))
    total = docs.count()
    free = rows.where((remainder(key, 5) != 0) & (order >= (1 << 39)) & (order < (1 << 39) + int((1 << 40) * min(0.5, most / max(1, total)))))
    free = free.select(F.lit(None).cast("int").alias("__y"), F.col(text).alias("text"), order.alias("order"))

    def run(batches):
        for b in slices(batches):
            out = [(t, sorted(frozenset(_WORDS(t.lower())))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("__y"), b.column("order"), pa.array([w for _, w in out], pa.list_(pa.string())),
                    pa.array([bool(_SHOUT(t)) for t, _ in out]), pa.array([bool(_MASKED(t)) for t, _ in out]),
                ],
                ["y", "order", "words", "shout", "masked"],
            )

    got = labelled.unionByName(free).mapInArrow(run, "y int, order long, words array<string>, shout boolean, masked boolean")
    return Sample.of(got.toArrow())


@dataclass
class Sample:
    """Rows as flat (row, feature) pairs with features numbered: a few bytes for each word of the sample."""

    y: np.ndarray  # 1, -1, or 0 where unknown
    shout: np.ndarray
    masked: np.ndarray
    names: list[str]
    row: np.ndarray
    feature: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> "Sample":
        lists = [sorted(w) for w in table.column("words").to_pylist()]
        y, order = (table.column(c).to_pylist() for c in ("y", "order"))
        rank = sorted(range(len(lists)), key=lambda k: (order[k], y[k] is None, lists[k]))
        ids: dict[str, int] = {}
        row, feature = [], []
        for at, k in enumerate(rank):
            f = np.fromiter({ids.setdefault(s, len(ids)) for w in lists[k] for s in stems(w)}, np.int32)
            row.append(np.full(len(f), at, np.int32))
            feature.append(np.sort(f))
            lists[k] = None
        pick = lambda c: np.array(table.column(c).to_pylist(), bool)[rank] if rank else np.zeros(0, bool)
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
        labels = np.array([0 if y[k] is None else 1 if y[k] > 0 else -1 for k in rank], np.int8)
        return Sample(labels, pick("shout"), pick("masked"), list(ids), flat(row), flat(feature))

    def odds(self, weight: np.ndarray, against: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per feature: its weight, log odds of ``weight`` rows over ``against`` rows, and that over its standard error."""
        n = len(self.names)
        one, zero = (np.bincount(self.feature, w[self.row], n) for w in (weight, against))
        t1, t0 = weight.sum(), against.sum()
        log = np.log((one + 0.5) / (t1 - one + 0.5)) - np.log((zero + 0.5) / (t0 - zero + 0.5))
        return one, log, log / np.sqrt(1 / (one + 0.5) + 1 / (zero + 0.5))


def _mine(sample: Sample, most: int, least: int = 4) -> list[str]:
    """Words and stems that mark toxic rows, strongest first by log odds over standard error.

    Of marks that share most of their toxic rows and begin alike, only the strongest stays.
    """
    one, log, z = sample.odds((sample.y > 0).astype(float), (sample.y < 0).astype(float))
    found = np.flatnonzero((one >= least) & (z > 6) & (log > 1))
    toxic = sample.y[sample.row] > 0
    rows = {f: set(sample.row[toxic & (sample.feature == f)].tolist()) for f in found.tolist()}
    out: list[int] = []
    for f in sorted(rows, key=lambda f: (-z[f], sample.names[f])):
        stem = sample.names[f].lstrip("^")[:4]
        alike = (v for v in out if sample.names[v].lstrip("^").startswith(stem))
        if not any(len(rows[v] & rows[f]) > 0.5 * len(rows[f]) for v in alike):
            out.append(f)
            if len(out) == most:
                break
    return [sample.names[f] for f in out]


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    most: int = 3000, n_mined: int = 40, n_features: int = 4000, steps: int = 300,
) -> Model:
    """Fit voters, label model and classifier on a sample bounded by ``most`` rows of each label and ``most`` others.

    Rows whose crc32 remainder by 5 is 0 are never read. Without labelled rows the fixed lists alone vote.
    """
    sample = _sample(docs, labels, key, text, label, most)
    voters = Voters({k: frozenset(v.split()) for k, v in LEXICONS.items()}, _mine(sample, n_mined))
    n = len(sample.y)
    if not n:
        return Model(voters, None, {w: 2.0 for v in LEXICONS.values() for w in v.split()}, np.zeros(3), -3.0)
    number = {f: k for k, f in enumerate(sample.names)}
    holds = lambda terms: np.isin(np.arange(n), sample.row[np.isin(sample.feature, [number[t] for t in terms if t in number])])
    hits = [holds(v) for v in voters.lists.values()] + [holds([w]) for w in voters.mined]
    any_hit = np.any(hits, 0)
    mined = np.sum(hits[len(voters.lists) :], 0) if voters.mined else np.zeros(n)
    votes = np.stack([*hits, sample.shout, sample.masked, mined >= 2, -(~any_hit).astype(np.int8), sample.y], 1).astype(np.int8)
    model = fit_label_model(votes)
    soft = model.posterior(votes)
    # Words and stems that the posterior tells apart best are the classifier's features.
    one, _, z = sample.odds(soft, 1 - soft)
    every = np.bincount(sample.feature, minlength=len(sample.names))
    good = np.flatnonzero((every >= 5) & (np.abs(z) > 3))
    good = good[np.lexsort((np.array([sample.names[f] for f in good.tolist()], object).astype(str), -np.abs(z[good])))][:n_features]
    column = np.full(len(sample.names), -1)
    column[good] = np.arange(len(good))
    columns = {sample.names[f]: k for k, f in enumerate(good.tolist())}
    n_words, extra = len(good), 3  # and three patterns
    t1, t0 = soft.sum(), n - soft.sum()
    kept = column[sample.feature] >= 0
    patterns = [sample.shout, sample.masked, any_hit]
    at = np.concatenate([sample.row[kept], *(np.flatnonzero(p) for p in patterns)])
    to = np.concatenate([column[sample.feature[kept]], *(np.full(p.sum(), n_words + k) for k, p in enumerate(patterns))])
    w, bias = np.zeros(n_words + extra), float(np.log(t1 / max(t0, 1e-9)) if t1 > 0 else -3.0)
    rate, m1, m2 = 0.05, np.zeros(n_words + extra + 1), np.zeros(n_words + extra + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(at, w[to], n), -30, 30)))
        g = (p - soft) / n
        grad = np.append(np.bincount(to, g[at], n_words + extra) + 2e-4 * w, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(voters, model, {v: float(w[k]) for v, k in columns.items()}, w[n_words:], bias)


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``key``, score (0 to 1) and predicted (1 from 0.5 on). Null and empty texts get the score of no word."""
    listed = frozenset().union(*model.voters.lists.values(), model.voters.mined)

    def run(batches):
        weights = model.weights
        known = weights.keys() | listed
        memo = Memo(lambda w: tuple(s for s in stems(w) if s in known))
        for b in slices(batches):
            z = []
            for t in b.column(1).to_pylist():
                t = t or ""
                words = set(chain.from_iterable(map(memo.__getitem__, set(_WORDS(t.lower())))))
                s = model.bias + sum(weights[w] for w in sorted(words & weights.keys()))
                s += model.patterns[0] * bool(_SHOUT(t)) + model.patterns[1] * bool(_MASKED(t))
                z.append(s + model.patterns[2] * (not listed.isdisjoint(words)))
            p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                [key, "score", "predicted"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
