"""Skewed keys: a sketch finds the heavy ones, and only these are salted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tranchery.functions import loan as L


def heavy_hashes(df: DataFrame, keys: list[str], share: float = 0.01) -> list[int]:
    """Hashes of the keys that may hold over ``share`` of all rows, from one pass.

    The sketch is that of frequent items: tasks keep a table of fixed size each, ten times 1 / share entries, and merge
    them, so no key is shuffled.  Its counts are within a tenth of the share, so none that heavy is missed, and one just
    below it may come along.  At most 2 / share hashes reach the driver."""
    tracked = max(1024, math.ceil(10 / share))
    top = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(math.ceil(2 / share)), F.lit(tracked))
    row = df.agg(F.count("*").alias("n"), top.alias("top")).first()
    return sorted(x["item"] for x in row["top"] or [] if x["count"] >= 0.9 * share * row["n"])


def heavy_hitters(df: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """Exactly the keys that hold at least ``share`` of all rows, with their counts: candidates by sketch, then counted."""
    some = heavy_hashes(df, keys, share)
    total = df.agg((F.count("*") * share).alias("_least"))
    counted = df.where(F.xxhash64(*keys).isin(some) if some else F.lit(False)).groupBy(*keys).agg(F.count("*").alias("cnt"))
    return counted.crossJoin(F.broadcast(total)).where(F.col("cnt") >= F.col("_least")).drop("_least")


def hot_salt(df: DataFrame, keys: list[str], by: str, buckets: int = 16, share: float = 0.01) -> Column:
    """A salt for heavy keys, from the hash of ``by``; 0 for all others, which stay in one group."""
    some = heavy_hashes(df, keys, share)
    return F.when(F.xxhash64(*keys).isin(some), L.salt(F.col(by), buckets)).otherwise(F.lit(0)) if some else F.lit(0)


def salted_sums(df: DataFrame, keys: list[str], value: str, salt_by: str, buckets: int = 16, share: float = 0.01) -> DataFrame:
    """Counts and sums per key in two stages, heavy keys dealt out over ``buckets`` groups first."""
    first = df.groupBy(*keys, hot_salt(df, keys, salt_by, buckets, share).alias("_salt")).agg(F.count("*").alias("c"), F.sum(value).alias("s"))
    return first.groupBy(*keys).agg(F.sum("c").alias("cnt"), F.sum("s").cast("double").alias("total"))


def salted_distinct(df: DataFrame, keys: list[str], value: str, buckets: int = 16, share: float = 0.01) -> DataFrame:
    """Distinct values per key, an aggregate that does not shrink before its shuffle: a heavy key's values are dealt out
    by their hash, so that each group counts values that no other has, and the counts add up."""
    first = df.groupBy(*keys, hot_salt(df, keys, value, buckets, share).alias("_salt")).agg(F.count_distinct(value).alias("n"))
    return first.groupBy(*keys).agg(F.sum("n").alias("distinct_values"))
