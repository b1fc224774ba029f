"""Quality rules from tokenizer fertility: how public vocabularies take a text to pieces tells prose from junk.

Each text is measured under every vocabulary. Bands follow from the table itself: per group of texts of one language (or
script, where a language is unknown or rare) and of like length (or any, where that is rare), the median of each measure and its spread, over all
texts that pass the base rules. Entropy grows with length, so lengths are classed by powers of four.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, few, mix64, slices, small_batches
from .pieces import encoder as piece_encoder

#: First and last code point of ranges, and the script they stand for.
SCRIPT_RANGES = [
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC0, 0x24F, "latin"), (0x370, 0x3FF, "greek"),
    (0x400, 0x52F, "cyrillic"), (0x530, 0x58F, "other"), (0x590, 0x5FF, "hebrew"), (0x600, 0x77F, "arabic"),
    (0x900, 0xDFF, "indic"), (0xE00, 0xE7F, "thai"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"),
]
#: What is measured under each vocabulary, the width of the bins it is counted in, and on which sides a text may lie
#: outside of the band: characters per token (both), share of byte-fallback tokens (above), bits per token (below).
MEASURES = (("chars_per_token", 1 / 256, -1, 1), ("byte_share", 1 / 1024, 0, 1), ("token_entropy", 1 / 128, -1, 0))
#: A band reaches so many standard deviations (from the median absolute deviation) to either side of the median, and
#: counts where a group has at least so many texts.
REACH, GROUP = 4.5, 100
#: Largest share of byte fallback, under the first vocabulary, of a text without letters that has no band.
WITHOUT_LETTERS = 0.6
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FIRST = np.array([(b & 0xC0) != 0x80 for b in range(256)])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more, the first included."""
    if len(words) <= width:
        return 0
    h = mix64(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64))
    step = 1
    while step < width:  # width is a power of two: windows of 1, 2, 4, 8 words
        h = mix64(h[:-step], step) * np.uint64(3) + h[step:]
        step *= 2
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_rules(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and whether the text fails on these."""
    data = text.encode()
    words = data.split()  # by ASCII white space
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars, symbols = int(counts[_FIRST & ~_SPACE].sum()), int(counts[_SYMBOL].sum())
    dup = 0
    if b"\n" in data:
        lines = [x for x in data.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    return len(words), chars, symbols, dup, repeat, len(words) < 20 or 100 * repeat > 30 * len(words)


def script_of(text: str) -> str:
    """The script of most letters; ``none`` without a letter of a known range."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "none"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = np.array([a for a, _, _ in SCRIPT_RANGES])
    at = np.searchsorted(starts, points, "right") - 1
    inside = (at >= 0) & (points <= np.array([b for _, b, _ in SCRIPT_RANGES])[at])
    totals: dict[str, int] = {}
    for k, n in enumerate(np.bincount(at[inside], minlength=len(starts))):
        totals[SCRIPT_RANGES[k][2]] = totals.get(SCRIPT_RANGES[k][2], 0) + int(n)
    best = max(totals, key=totals.get)
    return best if totals[best] else "none"


def entropies(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bits per token of each text's own token distribution; 0 for a text without tokens."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    s = np.sort(row << 32 | ids)
    at = np.flatnonzero(np.diff(s, prepend=-1))
    row, share = s[at] >> 32, np.diff(at, append=len(s)) / n[s[at] >> 32]
    return np.bincount(row, -share * np.log2(share), len(n)) if len(s) else np.zeros(len(n))


class Ranks:
    """A byte-level vocabulary of ranked merges. A token that isn't whole characters is one of byte fallback."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.is_byte = np.zeros(max(table.values()) + 1, bool)
        for token, i in table.items():
            self.is_byte[i] = token.decode(errors="ignore").encode() != token

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.library.encode_to_numpy(t, disallowed_special=()) if t else np.zeros(0, np.uint32) for t in texts]
        return np.concatenate([*lists, np.zeros(0, np.uint32)]).astype(np.int64), np.cumsum([0, *map(len, lists)])


@lru_cache(maxsize=2)
def _ranks(data: bytes, pattern: str) -> Ranks:
    return Ranks(data, pattern)


def vocabularies(names: tuple[str, ...] = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")) -> list[tuple[str, bytes, str]]:
    """(kind, file's bytes, pattern) of public vocabularies; together about 1.3 MB, which travel with the tasks."""
    import public_tokenizers

    out = []
    for name in names:
        with open(public_tokenizers.path(name), "rb") as f:
            out.append((name.rsplit(".", 1)[1], f.read(), public_tokenizers.PATTERN))
    return out


def measures(
    df: DataFrame, vocabularies: list[tuple[str, bytes, str]], key: str = "doc_id", text: str = "text", lang: str | None = "lang"
) -> DataFrame:
    """Per row: ``key``, the base counts, base_failed, lang, script, n_tokens (of the first vocabulary), and arrays with an
    entry per vocabulary: chars_per_token, byte_share, token_entropy (0 for texts without tokens)."""
    small_batches(df)
    known = F.col(lang).cast("string") if lang and lang in df.columns else F.lit(None).cast("string")

    def run(batches):
        encoders = [piece_encoder(data) if kind == "model" else _ranks(data, pattern) for kind, data, pattern in vocabularies]
        fallback = [e.v.is_byte if kind == "model" else e.is_byte for e, (kind, _, _) in zip(encoders, vocabularies, strict=True)]
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            length = np.array([len(t) for t in texts], np.int64)
            found, n_tokens = [], None
            for encoder, is_byte in zip(encoders, fallback, strict=True):
                ids, bounds = encoder.batch(texts)
                n = np.diff(bounds)
                n_tokens = n if n_tokens is None else n_tokens
                n_byte = np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[bounds])
                some = np.maximum(n, 1)
                found.append((length / some * (n > 0), n_byte / some, entropies(ids, bounds)))
            base = list(zip(*map(base_rules, texts), strict=True)) or [()] * 6
            types = [*[pa.int64()] * 5, pa.bool_()]
            columns = [pa.array(c, kind) for c, kind in zip(base, types, strict=True)]
            lists = [pa.array(np.stack(m, 1).tolist(), pa.list_(pa.float64())) for m in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *columns, b.column(2), pa.array(map(script_of, texts), pa.string()), pa.array(n_tokens, pa.int64()), *lists],
                [key, *BASE, "base_failed", "lang", "script", "n_tokens", *(m for m, *_ in MEASURES)],
            )

    kind = df.schema[key].dataType.simpleString()
    counts = ", ".join(f"{n} long" for n in BASE)
    arrays = ", ".join(f"{m} array<double>" for m, *_ in MEASURES)
    return df.select(key, text, known.alias("lang")).mapInArrow(
        run, f"`{key}` {kind}, {counts}, base_failed boolean, lang string, script string, n_tokens long, {arrays}"
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bands(rows: DataFrame, least: int = GROUP) -> DataFrame:
    """(group, middle, spread) of all groups with ``least`` texts or more that pass the base rules; the arrays have an
    entry per measure and vocabulary. Medians come from counts in narrow bins, so they are the same on every run."""
    flat = rows.where(~F.col("base_failed")).select(F.explode(F.array("of_lang", "of_script", "of_all")).alias("group"), F.posexplode("values").alias("m", "x"))
    flat = flat.where("group is not null")
    width = F.element_at(F.array(*(F.lit(MEASURES[k % 3][1]) for k in range(len(MEASURES)))), F.col("m") % len(MEASURES) + 1)

    def median(of, x):
        bins = of.groupBy("group", "m", F.floor(x / width).alias("bin")).agg(F.count("*").alias("n"))
        found = bins.groupBy("group", "m").agg(F.expr("percentile(bin, 0.5D, n)").alias("bin"), F.sum("n").alias("n"))
        return found.select("group", "m", ((F.col("bin") + 0.5) * width).alias("middle"), "n")

    middle = cut(median(flat, F.col("x")).where(F.col("n") >= least))
    away = flat.join(few(middle.drop("n")), ["group", "m"])
    spread = median(away, F.abs(F.col("x") - F.col("middle"))).withColumnRenamed("middle", "spread").drop("n")
    each = middle.join(spread, ["group", "m"]).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("m", "middle", "spread"))).alias("a"))
    return each.select("group", F.col("a.middle").alias("middle"), F.col("a.spread").alias("spread"))


def quality_rules(
    df: DataFrame, vocabularies: list[tuple[str, bytes, str]], key: str = "doc_id", text: str = "text", lang: str | None = "lang",
    reach: float = REACH, least: int = GROUP,
) -> DataFrame:
    """Per row: the base counts, base_failed, the fertility measures (an entry per vocabulary), the verdict's reason and
    kept.

    A text that passes the base rules is kept if all its measures lie within the band of its language and length, or
    of its script and length where the language is null or has fewer than ``least`` such texts; without either band
    it is kept. Null and empty texts have no words, fail the base rules and have measures of 0. Measures cover the
    whole text. Rows pass one by one: repeated rows and null keys stay; of other columns only ``lang`` is read.
    """
    rows = cut(measures(df, vocabularies, key, text, lang))
    length = F.greatest(F.lit(3), F.least(F.lit(6), F.floor(F.log2(F.greatest("n_tokens", F.lit(1))) / 2))).cast("string")
    names = [m for m, *_ in MEASURES]
    values = F.flatten(F.transform(F.arrays_zip(*names), lambda z: F.array(*(z[m] for m in names))))
    rows = rows.withColumn("of_lang", F.concat_ws("/", F.lit("lang"), "lang", length)).withColumn("of_lang", F.when(F.col("lang").isNotNull(), F.col("of_lang")))
    rows = rows.withColumn("of_script", F.concat_ws("/", F.lit("script"), "script", length))
    rows = rows.withColumn("of_all", F.concat_ws("/", F.lit("script"), "script")).withColumn("values", values)
    found = cut(bands(rows, least))
    for name in ("lang", "script", "all"):
        rows = rows.join(few(found.select(F.col("group").alias(f"of_{name}"), F.struct("middle", "spread").alias(f"by_{name}"))), f"of_{name}", "left")
    band = F.coalesce("by_lang", "by_script", "by_all")

    def outside(k: int):
        _, width, down, up = MEASURES[k % 3]
        x, at = F.element_at("values", k + 1), band["middle"][k]
        slack = reach * F.greatest(1.4826 * band["spread"][k], F.lit(2 * width))
        return F.coalesce((F.lit(bool(up)) & (x > at + slack)) | (F.lit(bool(down)) & (x < at - slack)), F.lit(False))

    reason = F.when(F.col("base_failed"), "base")
    for k in range(3 * len(vocabularies)):
        reason = reason.when(outside(k), names[k % 3])
    reason = reason.when(band.isNull() & (F.col("script") == "none") & (F.col("byte_share")[0] > WITHOUT_LETTERS), "byte_share")
    rows = rows.withColumn("reason", reason)
    return rows.select(key, *BASE, "base_failed", "script", "n_tokens", *names, "reason", F.col("reason").isNull().alias("kept"))
