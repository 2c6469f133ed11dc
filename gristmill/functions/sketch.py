"""HyperLogLog with 256 registers as a register table, and Spark's native sketches beside it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import next_power_of_two

REGISTERS = 256
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)


def register(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(REGISTERS - 1)).cast("int")


def rank(hash_: Column, bits: int = 64, group_bits: int = 0) -> Column:
    """1 + trailing zeros of the hash above its register bits; bits - 8 if they are all zero.

    group_bits: constant top bits of a grouped sketch, masked out.
    """
    if group_bits:
        hash_ = hash_.bitwiseAND(F.lit((1 << (bits - group_bits)) - 1))
    rest = F.shiftrightunsigned(hash_, 8)
    low = F.bit_count(rest.bitwiseAND(-rest) - 1)
    return F.when(rest == 0, bits - 8).otherwise(low + 1).cast("int")


def registers(df: DataFrame, hash_: Column, *by: str, bits: int = 64, group_bits: int = 0) -> DataFrame:
    """(by..., reg, rank): the sketch of each group; partial aggregation keeps at most 256 rows a group and task.

    group_bits: where the groups are the partition groups, the top bits of the hash that are the same within one.
    """
    return df.select(*by, register(hash_).alias("reg"), rank(hash_, bits, group_bits).alias("rank")).groupBy(*by, "reg").agg(F.max("rank").alias("rank"))


def merge_registers(tables: DataFrame, *by: str) -> DataFrame:
    """Register-wise maximum: union of sketches."""
    return tables.groupBy(*by, "reg").agg(F.max("rank").alias("rank"))


def estimate(table: DataFrame, *by: str) -> DataFrame:
    """(by..., estimate): bias-corrected harmonic mean, linear counting below 2.5 * 256 while registers are empty; truncated."""
    s = table.groupBy(*by).agg(F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"), F.count(F.lit(1)).alias("used"))
    zeros = F.lit(REGISTERS) - F.col("used")
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / (F.col("s") + zeros)
    linear = F.lit(float(REGISTERS)) * F.ln(F.lit(float(REGISTERS)) / F.greatest(zeros, F.lit(1)))
    value = F.when((zeros > 0) & (raw < 2.5 * REGISTERS), linear).otherwise(raw)
    return s.select(*by, F.floor(value).cast("bigint").alias("estimate"))


def table_slots(estimate_: Column, factor: float = 2.0) -> Column:
    """Slots of a final table for so many groups: the next power of two of factor * estimate."""
    return next_power_of_two(F.ceil(estimate_ * F.lit(factor)))


def native_sketch(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Spark's own HLL state (256 registers) for each group: merge with ``native_union``, read with ``native_estimate``."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(column, F.lit(8)).alias("sketch"))


def native_union(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def native_estimate(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.select(*by, F.hll_sketch_estimate("sketch").alias("estimate"))


def estimate_of(registers_: dict[int, int]) -> int:
    """The estimate of one register table, on the driver."""
    zeros = REGISTERS - len(registers_)
    raw = ALPHA * REGISTERS * REGISTERS / (sum(2.0**-r for r in registers_.values()) + zeros)
    return math.floor(REGISTERS * math.log(REGISTERS / zeros) if zeros and raw < 2.5 * REGISTERS else raw)
