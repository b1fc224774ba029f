"""Top-k, quotas, round robin and upserts: orderings with a total tie-break."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_per(df: DataFrame, by: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """The first ``n`` rows of each group; groups are cut before the shuffle too."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def global_and_regional(df: DataFrame, order: list[Column], g_limit: int, r_limit: int = 6, c_limit: int = 2) -> DataFrame:
    """Rows (id, country, region, ...) with place: first a global list with few per country, then regional quotas.

    What a greedy walk in rank order takes is a matter of ranks: within the country, then over all; and of the rest
    within the country's remaining share, then within the region. The global list caps a country at one if there are
    as many countries as places.
    """
    many = df.agg(F.count_distinct("country")).first()[0] >= g_limit
    cap = 1 if many else c_limit
    free = F.col("country").isNull()
    ranked = df.withColumn("__c", F.row_number().over(Window.partitionBy("country").orderBy(*order)))
    first = ranked.where(free | (F.col("__c") <= cap)).orderBy(*order).limit(g_limit)
    first = first.withColumn("place", F.row_number().over(Window.orderBy(*order))).drop("__c")
    taken = first.groupBy("country").agg(F.count("*").alias("__taken"))
    rest = ranked.drop("__c").join(first.select("id"), "id", "left_anti").join(taken.withColumnRenamed("country", "__tc"), F.col("country").eqNullSafe(F.col("__tc")), "left")
    rest = rest.withColumn("__c", F.row_number().over(Window.partitionBy("country").orderBy(*order)))
    rest = rest.where(free | (F.col("__c") <= c_limit - F.coalesce("__taken", F.lit(0))))
    rest = rest.withColumn("__region", F.coalesce("region", F.lit("Other")))
    rest = top_per(rest, ["__region"], order, r_limit, "__r")
    rest = rest.withColumn("place", g_limit + F.row_number().over(Window.orderBy(*order)))
    return first.unionByName(rest.select(*first.columns))


def round_robin(df: DataFrame, by: str, order: list[Column], out: str = "turn") -> DataFrame:
    """Rows in turns: the best of each group, then the second best of each; ``turn`` numbers them.

    A round has one row per group at most, so rows are numbered within their round, after the sizes of earlier rounds.
    """
    rows = df.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    sizes = rows.groupBy("__rn").agg(F.count("*").alias("__n"))
    ahead = F.sum("__n").over(Window.orderBy("__rn").rowsBetween(Window.unboundedPreceding, -1))  # a row a round
    sizes = sizes.select(F.col("__rn").alias("__r"), F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    place = F.row_number().over(Window.partitionBy("__rn").orderBy(*order))
    rows = rows.withColumn("__p", place).join(sizes, F.col("__rn") == F.col("__r"))
    return rows.withColumn(out, F.col("__ahead") + F.col("__p")).drop("__rn", "__r", "__p", "__ahead")


def insert_ignore(new: DataFrame, old: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The rows of ``new`` that a unique ``key`` lets in: the first of each, none that ``old`` has."""
    w = Window.partitionBy(key).orderBy(*order)
    return new.join(old.select(key), key, "left_anti").withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with ``new`` merged in by ``key``: a new value wins unless it is null."""
    names = [c for c in old.columns if c != key]
    n = new.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in names))
    joined = old.join(n, F.col(key) == F.col("__k"), "full_outer")
    return joined.select(F.coalesce(key, "__k").alias(key), *(F.coalesce(f"__{c}", c).alias(c) for c in names))


def union_distinct(parts: list[DataFrame], key: str) -> DataFrame:
    """Parts one after the other, each key where it comes first; ``part`` tells which part."""
    rows = reduce(DataFrame.unionByName, (p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)))
    return rows.groupBy(key).agg(F.min("part").alias("part"))
