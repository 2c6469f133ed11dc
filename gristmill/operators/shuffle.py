"""Redistribution: physical exchanges, their analytic profile, and a sink that discards rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import owner, partition_group, radix_partition


def redistribute(df: DataFrame, keys: Sequence[str], partitions: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (or chosen columns) hash-partitioned by keys. Any number of partitions; without one the session decides and AQE coalesces."""
    df = df.select(*columns) if columns else df
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def profile(df: DataFrame, hash_, partitions: int, key: str, bits: int = 64) -> DataFrame:
    """(part, n_rows, n_keys) of the radix partitions: rows are counted by key first, so a hot key is one row a task."""
    keyed = df.groupBy(radix_partition(hash_, partitions, bits).alias("part"), F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy("part").agg(F.sum("n").cast("bigint").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


def ownership(df: DataFrame, hash_, partitions: int, group: int, nodes: int, bits: int = 64) -> DataFrame:
    """``df`` with part, grp and node."""
    groups = max(1, partitions // group)
    df = df.withColumn("part", radix_partition(hash_, partitions, bits))
    df = df.withColumn("grp", partition_group(F.col("part"), group))
    return df.withColumn("node", owner(F.col("grp"), groups, nodes))


def discard(df: DataFrame) -> None:
    """Run a plan and drop its rows."""
    df.write.format("noop").mode("overwrite").save()
