"""SentencePiece encoding and decoding of whole texts (streaming Viterbi, see ``pieces``)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, small_batches
from .pieces import encoder as shared_encoder


def model_bytes(path: str | None = None) -> bytes:
    """A vocabulary file's bytes (about 0.5 MB); they travel with the tasks, so executors need no such file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _int_lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def encode(
    df: DataFrame, model: bytes, text: str = "text", out: str = "ids", kind: str = "bpe", check: str | None = None
) -> DataFrame:
    """``df`` with ``out``: the ids of ``text`` as array<int>. Null and empty texts give an empty array.

    With ``check``, a boolean column of that name tells whether the ids decode to the text again; the same process
    decodes, so that no second one has to hold the vocabulary. Existing columns of these names are replaced. Other
    columns pass through unchanged, nulls and repeated rows too.
    """
    added = [out, *([check] if check else [])]
    schema = df.drop(*added).schema.add(out, T.ArrayType(T.IntegerType()))
    names = [f.name for f in schema][:-1]
    if check:
        schema = schema.add(check, T.BooleanType())

    small_batches(df)

    def run(batches):
        encoder = shared_encoder(model, kind)
        for b in slices(batches):
            texts = b.column(text).to_pylist()
            ids, bounds = encoder.batch(texts)
            columns = [*(b.column(n) for n in names), _int_lists(ids, bounds)]
            if check:
                columns.append(pa.array(_same(encoder, ids, bounds, texts), pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    return df.mapInArrow(run, schema)


def _same(encoder, ids: np.ndarray, bounds: np.ndarray, texts: list[str | None]) -> list[bool]:
    """Whether ids decode to the texts; a literal U+2581 reads as a space, by the format."""
    out = []
    for start in range(0, len(texts), 32):  # a few texts' bytes at a time
        at = bounds[start : start + 33]
        decoded = encoder.decoded(ids[at[0] : at[-1]], at - at[0])
        out += [d == (t or "").replace("▁", " ").encode() for d, t in zip(decoded, texts[start : start + 32], strict=True)]
    return out


def decode(df: DataFrame, model: bytes, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with ``out``: the text of the array<int> column ``ids``; null gives null. Replaces a column ``out``."""
    schema = df.drop(out).schema.add(out, "string")
    names = [f.name for f in schema][:-1]

    def run(batches):
        encoder = shared_encoder(model)
        for b in slices(batches):
            texts = [None if i is None else encoder.decode(i) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], [*names, out])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of encoding and decoding in one pass over the texts.

    Columns: ``key``, n_bytes, n_tokens, n_byte_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), and
    round_trip: the ids decode to the text again (a literal U+2581 reads as a space, by the format). Null text counts
    as empty: no ids, round trip true. Rows pass one by one, whatever their keys; other columns are not read, so
    their names can't clash.
    """

    small_batches(df)

    def run(batches):
        encoder = shared_encoder(model)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            ids, bounds = encoder.batch(texts)
            n_byte = np.diff(np.concatenate([[0], np.cumsum(encoder.v.is_byte[ids])])[bounds])
            raw, at = ids.astype("<i4").tobytes(), (4 * bounds).tolist()
            crc = [zlib.crc32(raw[a:e]) for a, e in zip(at, at[1:], strict=False)]
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            columns = [pa.array(x, pa.int64()) for x in (n_bytes, np.diff(bounds), n_byte, crc)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *columns, pa.array(_same(encoder, ids, bounds, texts), pa.bool_())],
                [key, "n_bytes", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        run,
        f"`{key}` {kind}, n_bytes long, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean",
    )
