"""When pre-aggregation pays: the share of misses decides between two equivalent plans.

The decision is taken by the driver from one small aggregate over a Bernoulli sample of all partitions, of about ``rows`` rows (a
parameter): each task of the partial aggregate sees a part of the rows, and the share of distinct keys among so many rows is the share
that its table misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.aggregate import AggSpec, group_aggregate, raw_aggregate

OBSERVATIONS = 100_000
THRESHOLD = 0.7
ADAPTIVE_THRESHOLD = 0.2


def miss_ratio(df: DataFrame, keys: list[str]) -> DataFrame:
    """(observed, misses) over all rows of ``df``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("observed"), F.count(F.lit(1)).alias("misses"))


def useless(observed: Column, misses: Column, threshold: float = THRESHOLD, gate: int = OBSERVATIONS) -> Column:
    """True once more rows than ``gate`` were seen and more than ``threshold`` of them missed."""
    return (observed > gate) & (misses / observed > threshold)


def sampled(df: DataFrame, rows: int, seed: int = 1) -> DataFrame:
    """About ``rows`` rows (all of a smaller table) from every partition alike, whatever the order of the table."""
    total = df.count()
    return df if total <= rows else df.sample(False, rows / total, seed)


def adaptive_aggregate(df: DataFrame, spec: AggSpec, threshold: float = THRESHOLD, gate: int = OBSERVATIONS, sample: DataFrame | None = None) -> DataFrame:
    """``group_aggregate`` or ``raw_aggregate``, as the sample (about 1.2 * gate rows by default) says. Both give the same rows."""
    slim = df.select(*spec.keys)
    seen = sampled(slim, gate + gate // 5 + 1) if sample is None else sample.select(*spec.keys)
    return raw_aggregate(df, spec) if decide(seen, spec, threshold, gate) else group_aggregate(df, spec)


def decide(seen: DataFrame, spec: AggSpec, threshold: float = THRESHOLD, gate: int = OBSERVATIONS) -> bool:
    """Whether pre-aggregation is useless for such rows."""
    return bool(miss_ratio(seen, list(spec.keys)).select(useless(F.col("observed"), F.col("misses"), threshold, gate)).first()[0])
