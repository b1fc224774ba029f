"""Vector functions as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    once = F.transform(F.array(F.struct(_d(a).alias("v"), norm(a).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))
    return F.element_at(once, 1)  # the norm is worked out once, not for each component


def mean_vectors(df: DataFrame, by: list[str], vector: str, out: str = "centroid") -> DataFrame:
    """Element-wise means per group; partial sums meet, no group is gathered."""
    flat = df.select(*by, F.posexplode(_d(vector)).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("m"))
    return flat.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(out))
