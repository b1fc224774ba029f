"""Connected components of an edge table, without gathering any component in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """Per node of ``links`` (a, b): label, the smallest node of its component.

    Each round gives every node the smallest label among its neighbours, then follows labels once more (pointer
    jumping), so rounds grow with the logarithm of the longest path. Labels are written to the checkpoint folder.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("further"))
        step = cut(low.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("further", "low")).alias("new")))
        done = step.where("new <> label").isEmpty()
        labels = step.select("node", F.col("new").alias("label"))
        if done:
            return labels
