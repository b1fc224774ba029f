"""Connected components of an edge table by smallest labels and pointer jumping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a temporary one for a local session without."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidewire-"))
    return f"{sc._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read from there.

    Lineage ends, and so do size estimates: those of a checkpoint are the product of all joins before it, and in a loop
    of joins they grow until planning takes longer than the query.
    """
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of text that a broadcast may have.
FEW_ROWS, FEW_BYTES = 500_000, 32 << 20


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast where its rows and the bytes of its strings are within bounds; a shuffled join else."""
    text = [c for c, kind in df.dtypes if kind == "string"]
    size = sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text), F.lit(0))
    n, held = df.agg(F.count("*"), size).first()
    return F.broadcast(df) if n <= FEW_ROWS and held <= FEW_BYTES else df


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): the smallest node of each component. Nodes without an edge don't occur."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    at = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(at.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = at.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        up = at.select(F.col("node").alias("low"), F.col("component").alias("up"))
        new = cut(low.join(up, "low", "left").select("node", "component", F.least("low", F.coalesce("up", "low")).alias("new")))
        ended = new.where("new <> component").isEmpty()
        at = new.select("node", F.col("new").alias("component"))
        if ended:
            return at
