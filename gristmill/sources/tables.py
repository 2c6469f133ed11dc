"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Lazy scan of ``<data_dir>/<name>.parquet`` (a file or a folder); filters and columns are pushed down."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def partly_cached(df: DataFrame, percent: int, key: Column) -> DataFrame:
    """``df`` with about ``percent`` of its rows, by a hash of ``key``, in executor memory: a lost block is computed again. The rest is scanned."""
    if percent <= 0:
        return df
    warm = F.pmod(F.xxhash64(key), F.lit(100)) < percent
    hot = df.filter(warm).persist(StorageLevel.MEMORY_ONLY)
    return hot if percent >= 100 else hot.unionByName(df.filter(~warm))


def schema_text(df: DataFrame) -> str:
    """The column types, joined by bars."""
    return "|".join(f.dataType.simpleString() for f in df.schema)


def require(df: DataFrame, schema: str | T.StructType) -> DataFrame:
    """``df``, if it has the columns of ``schema`` with their types (others may come with them); else a ValueError that names what differs."""
    want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have[f.name].simpleString() if f.name in have else 'missing'}, wanted {f.dataType.simpleString()}" for f in want if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("schema: " + "; ".join(wrong))
    return df
