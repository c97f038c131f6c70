"""Splits and samples drawn from hashed keys, stable under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.functions.noise import uniform
from hushframe.operators.ranks import BUCKETS, running_total, smallest_per_group

# Up to this many rows a top-n keeps its heap per task; beyond it, bucket ranking.
HEAP_ROWS = 100_000


def hash_split(df: DataFrame, keys: Sequence[str], fraction: float, seed: str | int = 42, name: str = "is_test") -> DataFrame:
    """Add a boolean that is true for about ``fraction`` of the rows."""
    return df.withColumn(name, uniform(seed, *keys) < F.lit(float(fraction)))


def stratified_split(
    df: DataFrame, keys: Sequence[str], target: str, fraction: float = 0.2, seed: str | int = 42,
    name: str = "is_test", buckets: int = BUCKETS,
) -> DataFrame:
    """Mark ``round(fraction * n)`` rows of every class as test, exactly.

    The rows with the smallest hashes are taken; a class of any size is narrowed by
    hash buckets, never sorted as a whole.  ``keys`` identify a row.
    """
    quotas = df.groupBy(target).agg(F.round(F.count(F.lit(1)) * F.lit(float(fraction))).cast("bigint").alias("quota"))
    return smallest_per_group(df, [target], uniform(seed, *keys), keys, quotas, buckets).withColumnRenamed("_taken", name)


def balanced_sample(
    df: DataFrame, flag: str, keys: Sequence[str], seed: str | int = 42, buckets: int = BUCKETS
) -> DataFrame:
    """Equally many rows of each flag value: as many as the rarest has."""
    sizes = df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))
    rarest = sizes.agg(F.min("n")).first()[0] or 0
    quotas = sizes.select(flag, F.lit(rarest).alias("quota"))
    return smallest_per_group(df, [flag], uniform(seed, *keys), keys, quotas, buckets).filter("_taken").drop("_taken")


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed: str | int = 42) -> DataFrame:
    """``min(n, N)`` rows without replacement."""
    if n <= HEAP_ROWS:
        return df.withColumn("_u", uniform(seed, *keys)).orderBy("_u", *keys).limit(n).drop("_u")
    quotas = df.sparkSession.createDataFrame([(n,)], "quota bigint")
    return smallest_per_group(df, [], uniform(seed, *keys), keys, quotas).filter("_taken").drop("_taken")


def head_n(df: DataFrame, n: int | None, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in key order; all rows when ``n`` is None.

    Beyond a heap per task the rows are numbered by range partitions instead, so
    that a long head does not pass through one task; ``order`` is then a unique key.
    """
    if n is None:
        return df
    if n <= HEAP_ROWS:
        return df.orderBy(*order).limit(n)
    numbered = running_total(df.select("*", F.lit(0).alias("_g"), F.lit(1).alias("_one")), ["_g"], order, ["_one"])
    return numbered.filter(F.col("before__one") < n).select(*df.columns)


def slice_features(df: DataFrame, features: Sequence[str], n: int, keep: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` feature columns next to the columns to keep."""
    return df.select(*keep, *list(features)[:n])
