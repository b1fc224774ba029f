"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of presence: the number of byte n-grams (1 to 3) that both hold, over
the root of the product of their numbers. Nyström landmarks turn it into finite features, one-versus-rest kernel ridge
regression learns on these, and texts are scored in batches by two matrix products: presence by landmarks, then
landmark similarities by coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, remainder, slices, small_batches

UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits, fractions and numerals of any script are none."""
    return any(map(str.isalpha, text))


#: ASCII that is not a letter reads as a space; bytes of other characters stay.
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def gram_codes(text: str) -> list[np.ndarray]:
    """Codes of the text's 1-, 2- and 3-grams of UTF-8 bytes, lower case, runs of non-letters as one space."""
    a = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8)
    space = a == 32
    keep = np.ones(len(a), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    a = a[keep].astype(np.int32)
    two = (a[:-1] << 8) | a[1:]
    return [a, two, (two[:-1] << 8) | a[2:]]


def distinct_grams(text: str) -> np.ndarray:
    return np.unique(np.concatenate(gram_codes(text)))


@dataclass
class Model:
    """Fitted classifier; all arrays are bounded by the landmark, gram and label counts."""

    labels: list[str]
    grams: np.ndarray  # codes, sorted
    landmarks: np.ndarray  # grams x landmarks, columns of unit length
    coefficients: np.ndarray  # landmarks x labels
    least_known: float = 0.0  # share of known 3-grams below which a text is of no learned language


#: Part of the least share of known 3-grams of any training text (known from the other half of them) that a text must have.
KNOWN_PART = 0.7


def fit(
    texts: list[np.ndarray], labels: list[str], n_landmarks: int = 160, n_grams: int = 8192, ridge: float = 0.02
) -> Model:
    """Kernel ridge regression on Nyström features; ``texts`` are the distinct gram codes of each."""
    names = sorted(set(labels))
    codes, df = np.unique(np.concatenate(texts), return_counts=True)
    top = np.sort(codes[np.lexsort((codes, -df))[:n_grams]])
    # How much of a text is known that took no part: each half of the sample by what the other half has.
    halves = [np.intersect1d(np.concatenate([np.zeros(0, top.dtype), *texts[k::2]]), top) for k in (0, 1)]
    threes = [t[t >= 1 << 16] for t in texts]
    shares = [np.isin(t, halves[1 - k % 2]).mean() for k, t in enumerate(threes) if len(t)]
    x = np.zeros((len(texts), len(top)), np.float32)
    for row, t in enumerate(texts):
        at = np.searchsorted(top, t)
        at = at[(at < len(top)) & (top[np.minimum(at, len(top) - 1)] == t)]
        x[row, at] = 1
    x /= np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))
    y = np.array([names.index(v) for v in labels])
    # Landmarks: as many of each label in turn, in the sample's own (hashed) order.
    turn = np.empty(len(y), np.int64)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((np.arange(len(y)), turn))[:n_landmarks]
    marks = x[chosen].T
    k_nm, k_mm = (x @ marks).astype(np.float64), (marks.T @ marks).astype(np.float64)
    values, vectors = np.linalg.eigh(k_mm)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = k_nm @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y][:, None]
    a = phi.T @ (phi * weight) + ridge * len(y) * np.eye(phi.shape[1]) / 100
    return Model(names, top, marks, (root @ np.linalg.solve(a, phi.T @ (target * weight))).astype(np.float32), KNOWN_PART * min(shares, default=0.0))


def training_rows(df: DataFrame, key: str, text: str, label: str, keep, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of the key, as (label, order, codes)."""
    rows = df.where(keep & F.col(label).isNotNull() & F.col(text).isNotNull())
    order = F.pmod(F.xxhash64(F.lit("language"), F.col(key).cast("string")), F.lit(1 << 40))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row per label
    chosen = F.lit(False)
    for name, n in sorted(counts.items()):
        chosen = chosen | ((F.col(label) == name) & (order < int((1 << 40) * min(1.0, per_label / n))))
    picked = rows.where(chosen).select(F.col(label).alias("label"), order.alias("order"), F.col(text).alias("text"))

    def run(batches):
        lean()
        for b in slices(batches):
            codes = [distinct_grams(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), b.column("order"), pa.array([c.tolist() for c in codes], pa.list_(pa.int32()))],
                ["label", "order", "codes"],
            )

    return picked.mapInArrow(run, "label string, order long, codes array<int>")


def train(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 500) -> Model | None:
    """Fit on about ``per_label`` rows per label (a documented bound) whose crc32 remainder by 3 is not 1.

    Only rows with a label take part. None if there are none.
    """
    rows = training_rows(df, key, text, label, remainder(key, 3) != 1, per_label).collect()
    rows = sorted((r for r in rows if len(r["codes"]) > 1), key=lambda r: (r["order"], r["label"], r["codes"]))
    if not rows:
        return None
    return fit([np.array(r["codes"], np.int32) for r in rows], [r["label"] for r in rows])


class Scorer:
    """Scores texts in batches by matrix products."""

    def __init__(self, model: Model, sharpness: float = 4.0, rows: int = 128):
        self.m, self.sharpness, self.rows = model, sharpness, rows
        self.columns = np.full(1 << 24, len(model.grams), np.int16 if len(model.grams) < 32000 else np.int32)
        self.columns[model.grams] = np.arange(len(model.grams))

    def known(self, text: str) -> float:
        """The share of the text's 3-grams that the model has."""
        return float((self.columns[gram_codes(text)[2]] < len(self.m.grams)).mean())

    def score(self, texts: list[str]) -> np.ndarray:
        """Texts by labels, rows that add up to 1."""
        n = len(self.m.grams)
        out = np.empty((len(texts), len(self.m.labels)))
        for start in range(0, len(texts), self.rows):
            part = texts[start : start + self.rows]
            x = np.zeros((len(part), n + 1), np.float32)
            for row, t in enumerate(part):
                for codes in gram_codes(t):
                    x[row, self.columns[codes]] = 1
            x = x[:, :n]
            kernel = x @ self.m.landmarks / np.maximum(1, np.sqrt(x.sum(1, keepdims=True)))
            f = (kernel @ self.m.coefficients).astype(np.float64) * self.sharpness
            e = np.exp(f - f.max(1, keepdims=True))
            out[start : start + self.rows] = e / e.sum(1, keepdims=True)
        return out


def predict(
    df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", passing: bool = False, out: tuple[str, str] = ("lang_pred", "score"), learned: str | None = None
) -> DataFrame:
    """Per row ``key``, lang_pred and score (named by ``out``) (the winner's share, 0 to 1); with ``passing``, all of ``df``'s columns too.

    Null texts and texts without a letter get ``und`` and score 0, as all do without a model. Existing columns
    of these names are replaced. ``learned`` names a further column: whether the text is of a learned language at all, as
    its share of 3-grams that the model knows tells (``Model.least_known``). Rows are scored one by one: repeated rows get equal results.
    """
    added = [*out, *([learned] if learned else [])]
    kept = [c for c in df.columns if c not in added] if passing else list(dict.fromkeys([key, text]))
    given = [c for c in kept if passing or c == key]
    schema = df.select(*given).schema.add(out[0], "string").add(out[1], "double")
    schema = schema.add(learned, "boolean") if learned else schema

    small_batches(df)

    def run(batches):
        lean()
        scorer = Scorer(model) if model else None
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            known = [k for k, t in enumerate(texts) if scorer and t and has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                p = scorer.score([texts[k] for k in known])
                for k, best, s in zip(known, p.argmax(1), p.max(1), strict=True):
                    lang[k], score[k] = model.labels[best], float(s)
            more = []
            if learned:
                found = set(known)
                more = [pa.array([k in found and scorer.known(t) >= model.least_known for k, t in enumerate(texts)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in given), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *more],
                [*given, *added],
            )

    return df.select(*kept).mapInArrow(run, schema)
