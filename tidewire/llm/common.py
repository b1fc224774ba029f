"""Small helpers that the corpus operators share."""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space that separates words, and its complement as a pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where none is set a temporary folder serves a local session; other
    executors could not see it, so a cluster's session must name a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewire-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: later stages never recompute it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes that a broadcast may hold at most: the driver holds it several times over, and several at once.
FEW_BYTES = 48 << 20


def _bytes(c: Column, kind: T.DataType) -> Column | int:
    """About how many bytes a value takes in a row of Spark's; a number where all values take as many."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.ArrayType):
        one = _bytes(F.element_at(c, 1), kind.elementType)
        if isinstance(one, int):
            return F.greatest(F.size(c), F.lit(0)).cast("long") * one + 24
        return F.aggregate(c, F.lit(24).cast("long"), lambda s, x: s + F.coalesce(_bytes(x, kind.elementType), F.lit(0)).cast("long"))
    if isinstance(kind, T.StructType):
        parts = [_bytes(c[f.name], f.dataType) for f in kind.fields]
        return 16 + sum(p for p in parts if isinstance(p, int)) + sum((p for p in parts if not isinstance(p, int)), 0)
    return 8


def few(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, marked for broadcast if its rows take at most ``most`` bytes (``FEW_BYTES``), about, with 40 for each row's
    place in a table of hashes; a shuffled join takes it otherwise."""
    size = _bytes(F.struct(*df.columns), df.schema)
    held = df.agg(F.coalesce(F.sum(F.lit(40).cast("long") + size), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= (FEW_BYTES if most is None else most) else df


def whole_row(names: list[str]) -> list[Column]:
    """What a hash of a whole row takes: each column and whether it is null, for hashes pass over nulls."""
    return [x for c in names for x in (F.col(c), F.col(c).isNull())]


def small_batches(df: DataFrame, most: str = "8m") -> None:
    """Have the session send workers Arrow batches of at most ``most``, unless it was told otherwise than the default.

    A batch is held in the JVM and in the worker at once, whatever the worker makes of it.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "64m") in ("67108864b", "64m", "64MB"):
        conf.set(name, most)


def slices(batches, rows: int = 256):
    """Arrow batches in small pieces, so that what a worker makes of one never grows with the batch."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


class Memo(dict):
    """Results of ``f`` for short words met before; takes no more once it is full."""

    def __init__(self, f, most: int = 500_000, longest: int = 64):
        super().__init__()
        self.f, self.most, self.longest = f, most, longest

    def __missing__(self, word):
        out = self.f(word)
        if len(self) < self.most and len(word) <= self.longest:
            self[word] = out
        return out


def lean() -> None:
    """In a worker process: let go of the vocabularies and memos that tasks of an encoding operator left there."""
    import sys

    pieces = sys.modules.get("tidewire.llm.pieces")
    if pieces:
        pieces.encoder.cache_clear()


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised; equal inputs give equal outputs everywhere."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all runs of ``width`` words: a polynomial, put together from runs of half the width."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    base, out, have = 0xD6E8FEB86659FD93, hashes, 1
    for bit in bin(width)[3:]:
        out = out[:-have] * np.uint64(pow(base, have, 1 << 64)) + out[have:]
        have *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(base) + hashes[have:]
            have += 1
    return mix64(out)


class Staged:
    """A table written as Parquet in the shared checkpoint folder, to be dropped once nothing reads it any more.

    ``by`` gives folders by a column's values; ``bucket`` as many buckets by a column as a shuffle has partitions, so that
    joins on it don't shuffle the table.
    """

    def __init__(self, df: DataFrame, by: str | None = None, bucket: str | None = None):
        import uuid

        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.path = f"{base}/staged-{uuid.uuid4().hex}"
        self.name = None
        if bucket:
            self.name = f"staged_{uuid.uuid4().hex}"
            buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
            df.write.format("parquet").bucketBy(buckets, bucket).option("path", self.path).saveAsTable(self.name)
            self.df = spark.table(self.name)
        else:
            (df.write.partitionBy(by) if by else df.write).parquet(self.path)
            self.df = spark.read.schema(df.schema).parquet(self.path)

    def add(self, df: DataFrame) -> Staged:
        """Append rows; a reader made before doesn't see them."""
        df.write.mode("append").parquet(self.path)
        self.df = df.sparkSession.read.schema(self.df.schema).parquet(self.path)
        return self

    def drop(self) -> None:
        jvm, sc = self.df.sparkSession._jvm, self.df.sparkSession.sparkContext
        if self.name:
            self.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order, name: str = "number") -> tuple[DataFrame, int]:
    """``df`` with dense numbers from 0 in the total order given, and the number of rows.

    Rows are range-partitioned and numbered range by range as they are written; a range adds the rows of those before it,
    which is one number a range, whatever the number of rows.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    rows, part = Staged(sorted_rows).df, F.shiftright("__row", 33)
    ahead, total = [], 0
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():
        ahead.append((r.part, total))
        total += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(ahead, "__part long, __ahead long"))
    rows = rows.join(starts, part == F.col("__part")).withColumn(name, F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__ahead"))
    return rows.drop("__row", "__part", "__ahead"), total
