"""Packing documents into sequences along a space-filling curve.

Each document's token ids are hashed into a vector, which fixed random directions project to a few dimensions. The
Hilbert curve through that space visits neighbours one after the other, so documents sorted by their place on it and
written end to end share their sequences with documents like them. Rows are range-sorted by that place; each range numbers
its own ids as it is written, and adds the ids of the ranges before it, a number a range. Sequences are cut from the one
stream of all ids: all are full, and what the last cannot fill becomes sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Staged, slices

#: Dimensions of the hashed vector, of the curve, and bits of each of the curve's coordinates (below 64 together).
HASHED, DIMENSIONS, BITS = 512, 4, 15
#: Ids that one range of the curve holds, about.
RANGE_IDS = 8_000_000
#: Pieces of words that a worker remembers, none longer in bytes.
MEMO_PIECES, LONG_PIECE = 900_000, 64


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The text of a public tokenizer's file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


#: Fixed value: how the public tokenizer cuts a text without white space into what it merges within.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case ASCII.
_CUT = re.compile(rb"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\sa-z0-9]+").findall


class Encoder:
    """Ids of whole texts as the library gives them, each distinct piece of text encoded about once.

    The tokenizer must drop white space and let no token cross it, so a text's ids are those of its words between ASCII
    spaces in turn; ``tokenizer_file`` names such a one, and a constructor check refuses others. Where it cuts words by
    ``PIECES`` after lower-casing, ASCII texts are cut here, so that the library sees a word once and not with every
    punctuation. Pieces met before are remembered, up to ``MEMO_PIECES``; ids are kept as little-endian bytes.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.library = tokenizers.Tokenizer.from_str(definition)
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.cuts = json.dumps(PIECES)[1:-1] in definition and '"Lowercase"' in definition
        self.zero = self.library.encode("0", add_special_tokens=False).ids[-1]
        self.memo: dict[bytes, bytes] = {}
        probe = "it's Two  words\n<|endoftext|>\t42 'tis"
        if self.encode([probe])[0].tolist() != self.library.encode(probe, add_special_tokens=False).ids:
            raise ValueError("this tokenizer's tokens depend on white space")

    def _library(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The library's ids of each. Where a digit is always a token of its own, one call takes all pieces that hold no
        "0", with one between each two."""
        together = [p for p in pieces if b"0" not in p and b"<|" not in p] if self.cuts else []
        alone = [p for p in pieces if b"0" in p or b"<|" in p] if self.cuts else pieces
        out = {p: np.array(x.ids, self.kind).tobytes() for p, x in zip(alone, self.library.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False))}
        if together:
            ids = np.array(self.library.encode_batch_fast([(b" 0 ".join(together) + b" 0").decode()], add_special_tokens=False)[0].ids, self.kind)
            ends, raw, size = np.flatnonzero(ids == self.zero), ids.tobytes(), self.kind.itemsize
            starts = np.concatenate(([0], ends[:-1] + 1))
            out.update((p, raw[a:e]) for p, a, e in zip(together, (starts * size).tolist(), (ends * size).tolist(), strict=True))
        return out

    def _pieces(self, text: str) -> list[bytes]:
        raw = text.encode()
        return _CUT(raw.lower()) if self.cuts and text.isascii() and "<|" not in text else raw.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = list(map(self._pieces, texts))
        new = list(set().union(*cut).difference(self.memo))
        found = self._library(new) if new else {}
        room = MEMO_PIECES - len(self.memo)
        self.memo.update(found)
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, c)), self.kind) for c in cut]
        for k, p in enumerate(new):
            if k >= room or len(p) > LONG_PIECE:
                del self.memo[p]
        return out


_encoders: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """One encoder a worker process."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def projected(ids: list[np.ndarray], seed: int = 13) -> np.ndarray:
    """Each document's hashed vector (roots of counts, unit length) on ``DIMENSIONS`` random directions."""
    out = np.zeros((len(ids), HASHED))
    for row, x in enumerate(ids):
        buckets = (x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(HASHED)
        out[row] = np.sqrt(np.bincount(buckets.astype(np.int64), minlength=HASHED))
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out @ np.random.default_rng(seed).standard_normal((HASHED, DIMENSIONS))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of rows of cell numbers, each below 2^bits.

    From the highest bit down, the quadrant a cell lies in says which coordinates are exchanged or reflected in what
    is below; the bits left over, read across the coordinates in Gray code, are the place.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for k in range(n):
            high = (x[k] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(high, low, swap)
            x[k] ^= swap
    for k in range(1, n):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            place = (place << 1) | ((x[k] >> bit) & 1)
    return place


def cells(points: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Cell numbers of points: each coordinate by its share under a logistic curve of the corpus's mean and spread, so
    that cells hold documents about evenly and every point, however far, has a cell."""
    z = np.clip((points - mean) / np.maximum(spread, 1e-9), -18, 18)
    return np.minimum((1 << BITS) - 1, (1 << BITS) / (1 + np.exp(-1.702 * z))).astype(np.int64)


def tail_cuts(rest: int) -> list[int]:
    """Ends of the sequences that ``rest`` ids make: powers of two, the largest first."""
    ends, at = [], 0
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def pack(df: DataFrame, definition: str | None = None, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, then ``end_id``; a null text is the empty one, so every row has an id at least.
    Each sequence holds ``length`` ids, but the last ones, whose lengths are powers of two. Rows with one place on the
    curve (copies, empty texts) are split over ranges like others, by row; equal rows and null keys are rows like others. ``length`` is a
    power of two itself. An empty table has no pieces. Rows come in the curve's order.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    definition, spark = definition or tokenizer_file(), df.sparkSession
    width = Encoder(definition).kind
    kind, arrow_kind = df.schema[key].dataType.simpleString(), to_arrow_type(df.schema[key].dataType)
    axes = [f"x{k}" for k in range(DIMENSIONS)]

    def encode(batches):
        encoder = _encoder(definition)
        for b in slices(batches):
            ids = [np.append(x, encoder.kind.type(end_id)) for x in encoder.encode([t or "" for t in b.column("__text").to_pylist()])]
            at = projected(ids)
            yield pa.RecordBatch.from_arrays(
                [b.column("__key"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), *(pa.array(at[:, k]) for k in range(DIMENSIONS))],
                ["key", "ids", "n", *axes],
            )

    rows = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(encode, f"key {kind}, ids binary, n long, {', '.join(f'{a} double' for a in axes)}")
    coded = Staged(rows.withColumn("row", F.monotonically_increasing_id()))
    total, *moments = coded.df.agg(F.coalesce(F.sum("n"), F.lit(0)), *(f(a) for f in (F.avg, F.stddev_pop) for a in axes)).first()
    mean, spread = np.array([m or 0.0 for m in moments]).reshape(2, DIMENSIONS)

    @F.pandas_udf("long")
    def place(*columns):
        import pandas as pd

        return pd.Series(hilbert(cells(np.stack(columns, 1), mean, spread)))

    def laid_end_to_end(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = at + np.cumsum(b.column("n").to_numpy())
            starts = np.concatenate(([at], ends[:-1]))[: len(ends)]
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("ids"), b.column("n"), pa.array(np.full(len(ends), part, np.int32)), pa.array(starts, pa.int64())], ["key", "ids", "n", "part", "at"])

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_IDS))
    curve = coded.df.select("key", "ids", "n", "row", place(*axes).alias("place")).repartitionByRange(ranges, "place", "row").sortWithinPartitions("place", "row")
    laid = Staged(curve.select("key", "ids", "n").mapInArrow(laid_end_to_end, f"key {kind}, ids binary, n long, part int, at long"))
    coded.drop()
    ahead, held = {}, 0
    for r in laid.df.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a number a range
        ahead[r.part], held = held, held + r.n
    full, rest = divmod(total, length)
    ends = np.array(tail_cuts(rest), np.int64)  # a handful

    def cut_up(batches):
        for b in slices(batches):
            out: list[tuple] = []
            for k, raw, n, part, at in zip(*(b.column(c).to_pylist() for c in ("key", "ids", "n", "part", "at"))):
                ids, start, place = np.frombuffer(raw, width).astype("<u4"), 0, ahead[part] + at
                while start < n:
                    sequence, offset, room = place // length, place % length, length - place % length
                    if sequence == full:
                        number = int(np.searchsorted(ends, offset, "right"))
                        first = int(ends[number - 1]) if number else 0
                        sequence, room, offset = full + number, int(ends[number]) - offset, offset - first
                    take = min(room, n - start)
                    out.append((k, start, take, ids[start : start + take].tobytes(), n, sequence, offset))
                    start, place = start + take, place + take
                if len(out) >= 1024:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)

    kinds = [arrow_kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

    def rows_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    pieces = laid.df.mapInArrow(cut_up, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("key", key)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence: its pieces by offset; no more pieces than ids, so groups are small."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda out, x: F.concat(out, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", joined.alias("ids"))
