"""Token counts of whole texts by a compiled finite-state transducer (see ``pieces.Machine``).

Transitions carry the change of the token count. Texts are cut into chunks of fixed size, wherever these end; each
chunk has a map from the states it may begin in to the state it ends in, and maps compose in a prefix scan.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, small_batches
from .pieces import encoder as shared_encoder


def token_counts(
    df: DataFrame, model: bytes, key: str = "doc_id", text: str = "text", limit: int = 4096
) -> DataFrame:
    """Per row: ``key``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``).

    Null and empty texts have 0 bytes and 0 tokens. Counts are those of the vocabulary's own library, without begin,
    end or other special tokens. Rows pass one by one, so repeated rows and null keys stay as they are; other columns
    are not read, so their names can't clash.
    """
    small_batches(df)

    def run(batches):
        counter = shared_encoder(model, counted=True)
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            n = counter.counts(texts)
            n_bytes = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
