"""The synthetic table of 16 columns, page numbering, and the cluster description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_PAGE = 25
CONFIG = "coordinator struct<ip:string,port:string>, workers array<struct<ip:string,port:string>>"


def generated(spark: SparkSession, pages: int, groups: int, seed: int = 0) -> DataFrame:
    """``pages`` * 25 rows; c0 is one of ``groups`` uniform 64-bit keys, the others are independent. All from hashes of the row
    number: the same rows at any parallelism, and nothing is collected."""
    i = F.col("id")

    def bits(k: int) -> Column:
        return F.xxhash64(i, F.lit(seed), F.lit(k))

    def text(k: int, n: int) -> Column:
        return F.concat(*[F.char(F.lit(33) + F.pmod(F.xxhash64(i, F.lit(seed), F.lit(k), F.lit(j)), F.lit(94))) for j in range(n)])

    pick = F.pmod(bits(0), F.lit(max(groups, 1)))
    cols = [F.xxhash64(pick, F.lit(seed)).alias("c0")]
    cols += [bits(k).alias(f"c{k}") for k in range(1, 4)]
    cols += [(F.pmod(bits(k), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))).alias(f"c{k}") for k in range(4, 8)]
    cols += [text(k, 1).alias(f"c{k}") for k in (8, 9)]
    cols += [F.pmod(bits(k), F.lit(1 << 31)).cast("int").alias(f"c{k}") for k in range(10, 13)]
    cols += [text(k, n).alias(f"c{k}") for k, n in ((13, 25), (14, 10), (15, 44))]
    return spark.range(pages * ROWS_PER_PAGE).select(*cols)


def random_value(kind: T.DataType, row: Column, seed: int) -> Column:
    """A uniform value of a type from a hash of ``row``: printable characters, integers, floats in [0, 1), structs and arrays of three of them."""
    bits = F.xxhash64(row, F.lit(seed))
    if isinstance(kind, T.StructType):
        return F.struct(*[random_value(f.dataType, row, seed * 31 + i + 1).alias(f.name) for i, f in enumerate(kind)])
    if isinstance(kind, T.ArrayType):
        return F.array(*[random_value(kind.elementType, row, seed * 31 + i + 1) for i in range(3)])
    if isinstance(kind, T.StringType):
        return F.char(F.lit(33) + F.pmod(bits, F.lit(94)))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (F.pmod(bits, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))).cast(kind)
    return F.pmod(bits, F.lit(1 << 31)).cast(kind) if isinstance(kind, T.IntegerType) else bits.cast(kind)


def node_pages(pages: Column, nodes: Column) -> Column:
    """Pages of each node's slice."""
    return F.floor(pages / nodes).cast("bigint")


def page_of(position: Column, rows: int = ROWS_PER_PAGE) -> Column:
    """Page of a dense row number: no window, no exchange."""
    return F.floor(position / rows).cast("bigint")


def cluster_config(spark: SparkSession, path: str) -> DataFrame:
    """(role, node, ip, port) of a JSON file {coordinator: {ip, port}, workers: [{ip, port}]}; a worker's node is its index."""
    return cluster_nodes(spark.read.json(path, multiLine=True, schema=CONFIG))


def cluster_nodes(c: DataFrame) -> DataFrame:
    """The same of rows (coordinator, workers)."""
    head = c.select(F.lit("coordinator").alias("role"), F.lit(None).cast("int").alias("node"), "coordinator.*")
    rest = c.select(F.posexplode("workers").alias("node", "w")).select(F.lit("worker").alias("role"), "node", "w.*")
    return head.unionByName(rest)
