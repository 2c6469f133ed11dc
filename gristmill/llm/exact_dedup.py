"""Operator 6. Exact dedup by distributed MSD radix partitioning.

Documents are split into groups by byte length and their first bytes, then each group by its next bytes, and so on,
until a group is a singleton or its texts have ended. Equality is decided by the bytes alone, with no digest. The slice
grows from level to level, so that the number of levels is logarithmic up to ``MOST_SLICE`` bytes. The first level
moves only that slice of each document (aggregated before the exchange, so that thousands of copies cost one row a
task). Of the documents that share it the next slice moves, and the rest of the text only of those that go on behind it. The plan is the
same at every size: joins are sieved by a bitmap of fixed size, and nothing else is broadcast.

Defined cases: a NULL text equals nothing and is kept; empty texts equal each other; of equal texts the one with the
least doc_id stays (NULL ids last, then by the other columns' JSON; of rows equal in all columns one); other columns,
whatever their names, take no part and come out unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import drop_rows, join_rows, unpacked, with_row_id, written

FIRST_SLICE = 64
SLICE_GROWTH = 64
MOST_SLICE = 1 << 20


def _slice(text: Column, start: int, n: int) -> Column:
    return F.substring(text.cast("binary"), start + 1, n)


def _radix(keyed: DataFrame, first: int, growth: int) -> DataFrame:
    """(rid, keep) of every document of ``keyed`` (row, rid) but the kept one of each group of equal texts."""
    text = F.col("row").getField("text")
    n = F.octet_length(text).cast("bigint")
    base = keyed.select("rid", n.alias("n"), _slice(text, 0, first).alias("s")).filter("n IS NOT NULL")
    shared = base.groupBy("n", "s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = written(shared.select("n", "s", F.monotonically_increasing_id().alias("gid")), "radix-keys")
    suspects = written(join_rows(base, shared, "n", "s").select("rid", "gid", "n"), "radix-suspects")
    most = suspects.agg(F.max("n")).first()[0] or 0

    ended = [suspects.filter(F.col("n") <= first).select("rid", "gid")]
    open_ = None
    at, width = first, first * growth
    while at < most:
        if open_ is None:
            open_ = join_rows(keyed.filter(n > at).select("rid", text.alias("text")), suspects.filter(F.col("n") > at), "rid")
            open_ = open_.withColumn("text", F.substring(F.col("text").cast("binary"), at + 1, 1 << 30))
            open_ = written(open_, "radix-level")
        # a text that ends here moves no more than its slice; what follows the slice moves with the others
        split = open_.select("rid", "gid", "n", _slice(F.col("text"), 0, width).alias("s"), F.when(F.col("n") > at + width, F.substring("text", width + 1, 1 << 30)).alias("text"))
        again = split.groupBy("gid", "s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        again = written(again.select("gid", "s", F.monotonically_increasing_id().alias("g2")), "radix-keys")
        kept = join_rows(split, again, "gid", "s").select("rid", F.col("g2").alias("gid"), "n", "text")
        at += width
        width = min(width * growth, MOST_SLICE)
        level = written(kept, "radix-level")
        ended.append(level.filter(F.col("n") <= at).select("rid", "gid"))
        open_ = level.filter(F.col("n") > at)
    groups = ended[0].withColumn("lv", F.lit(0))
    for i, e in enumerate(ended[1:], 1):
        groups = groups.unionByName(e.withColumn("lv", F.lit(i)))
    best = groups.groupBy("lv", "gid").agg(F.min("rid").alias("keep"))
    return groups.join(best, ["lv", "gid"]).filter("rid <> keep").select("rid", "keep")


def exact_duplicates(docs: DataFrame, first: int = FIRST_SLICE, growth: int = SLICE_GROWTH) -> DataFrame:
    """One row (doc_id, kept_doc_id) for each document whose text equals an earlier document's; kept_doc_id is the group's least."""
    keyed, kind = with_row_id(docs)
    dups = _radix(keyed, first, growth)
    if kind == "clean":
        return dups.select(F.col("rid").alias("doc_id"), F.col("keep").alias("kept_doc_id"))
    ids = keyed.select("rid", F.col("row").getField("doc_id").cast("bigint").alias("doc_id"))
    kept = ids.select(F.col("rid").alias("keep"), F.col("doc_id").alias("kept_doc_id"))
    return dups.join(ids, "rid").join(kept, "keep").select("doc_id", "kept_doc_id")


def drop_exact_duplicates(docs: DataFrame, first: int = FIRST_SLICE, growth: int = SLICE_GROWTH) -> DataFrame:
    """``docs`` with one document of each group of equal texts, in its own columns."""
    keyed, _ = with_row_id(docs)
    return unpacked(drop_rows(keyed, written(_radix(keyed, first, growth).select("rid"), "radix-drop"), "rid"), docs.columns)
