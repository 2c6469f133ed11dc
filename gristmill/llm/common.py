"""Shared pieces of the corpus operators: the shared folder, written intermediate tables, row identity, joins by row number.

Ids (``doc_id``, ``conv_id``, ``page_id``) are integers: they are cast to bigint, and a text that is no number raises.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.plans.chunked import shared_folder

#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: 64-bit words of the bitmap that sieves rows before a join: a fixed size, whatever the input.
SIEVE_WORDS = 1 << 19


class Scratch:
    """The tables of one run. Nothing is deleted but by its owner, and only what was written within ``with``."""

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        Scratch._open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        Scratch._open.remove(self)

    def release(self) -> None:
        """Delete the tables: for a caller that has written the results that read them."""
        while self.paths:
            remove(self.spark, self.paths.pop())


def small_batches(spark: SparkSession) -> None:
    """Let at most BATCH_BYTES go to Python at once, where the session has Spark's default: two tasks' batches of 64 MB, each of which grows by
    doubling and is held on both sides, are a good part of a small executor. Rows and results don't depend on it."""
    if spark.conf.get(_BATCH) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if Scratch._open:
        Scratch._open[-1].paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: lineage is cut and a lost executor costs one re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sieve(ids: DataFrame, *key: str) -> DataFrame:
    """(_word, _bits): a bitmap of the hashes of ``ids``, at most SIEVE_WORDS rows."""
    word = ids.select(_word(key).alias("_word"), F.expr(f"shiftleft(1L, {_bit(key)})").alias("_bit"))
    return word.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def _word(key: tuple[str, ...]) -> Column:
    return F.expr(f"pmod(xxhash64({', '.join(key)}), {SIEVE_WORDS}L)")


def _bit(key: tuple[str, ...]) -> str:
    return f"cast(pmod(xxhash64({', '.join(key)}, 1), 64L) as int)"


def _sieved(big: DataFrame, ids: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """``big`` with _hit: false where the bitmap proves that a row's key is not among ``ids``."""
    d = big.withColumn("_word", _word(key)).join(F.broadcast(_sieve(ids, *key)), "_word", how)
    return d.withColumn("_hit", F.expr(f"coalesce(shiftright(_bits, {_bit(key)}) & 1L, 0L) = 1L")).drop("_word", "_bits")


def likely_rows(big: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """The rows of ``big`` that a bitmap of fixed size can't rule out of ``ids``, without an exchange: all that have their key there, and some others."""
    return _sieved(big, ids, key, "inner").filter("_hit").drop("_hit")


def join_rows(big: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """Inner join on ``key``. A bitmap of fixed size is broadcast first, so that of ``big`` only the rows that it can't rule out are
    exchanged: one plan at every size, and one exchange of the rows that are wanted."""
    return likely_rows(big, ids, *key).join(ids.hint("shuffle_hash"), list(key))


def drop_rows(big: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """Anti join on ``key``. The rows that a bitmap of fixed size proves to stay never leave their task."""
    d = _sieved(big, ids, key, "left")
    return d.filter("NOT _hit").select(*big.columns).unionByName(d.filter("_hit").drop("_hit").join(ids.hint("shuffle_hash"), list(key), "left_anti").select(*big.columns))


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as the struct column ``row`` beside computed columns, so that no name of the input can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in columns.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def order_json(df: DataFrame, *without: str) -> Column:
    """A total order over the columns other than ``without``: their JSON text."""
    rest = [c for c in df.columns if c not in without and c != "text"]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest])) if rest else F.lit("")


def with_row_id(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` as (row, rid): rid is a unique bigint whose order is the order of ``key``.

    Where the key is unique and never NULL it is the id, after one slim pass over that column. Otherwise (NULL keys,
    repeated rows) the table is sorted by key, other columns and text, numbered, and written to the shared folder, so
    that the numbers are the same for every reader.
    """
    spark = docs.sparkSession
    bad = docs.groupBy(F.col(f"`{key}`").cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("k IS NULL OR n > 1").limit(1).count()
    if not bad:
        return packed(docs, rid=F.col(f"`{key}`").cast("bigint")), "clean"
    p = packed(docs, k=F.col(f"`{key}`").cast("bigint"), o=order_json(docs, key), t=F.col("text") if "text" in docs.columns else F.lit(""))
    p = p.orderBy(F.col("k").asc_nulls_last(), "o", "t")
    return written(p.select("row", F.monotonically_increasing_id().alias("rid")), "numbered"), "numbered"


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """(bytes of text, rows) of all documents."""
    r = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0)), F.count(F.lit(1))).first()
    return int(r[0]), int(r[1])
