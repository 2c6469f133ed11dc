"""The corpus pipeline: quality rules, exact dedup, near dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the shared folder
and reads it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm.common import Scratch, remove, scratch_path
from gristmill.llm.exact_dedup import drop_exact_duplicates
from gristmill.llm.jaccard_join import drop_near_duplicates
from gristmill.llm.mixing import mix
from gristmill.llm.packing import pack
from gristmill.llm.quality import keep_quality

#: The quality cutoffs are exact binomial bounds around a fitted score, which SQL can't express.
ORACLE_SQL = None

#: By the folder of a run: the intermediate tables of its latest stage.
_latest: dict[str, Scratch] = {}


def _turn(spark: SparkSession, sf_dir: str) -> Scratch:
    """The scratch of the stage that begins. What the stage before it in the same folder left goes: its result has been written."""
    if sf_dir in _latest:
        _latest[sf_dir].release()
    _latest[sf_dir] = Scratch(spark)
    return _latest[sf_dir]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: ``docs`` without those that the rules reject, fitted and calibrated on ``labels`` of sf_dir. Without usable labels only
    NULL and word-less texts go; an empty table stays empty."""
    with _turn(spark, sf_dir):
        return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of equal texts stays, the least by doc_id (NULL ids last); NULL texts equal nothing and stay."""
    with _turn(spark, sf_dir):
        return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document, the least by doc_id, of each group that pairs above the threshold connect; documents without words stay."""
    with _turn(spark, sf_dir):
        return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: each source cut or repeated to its budget; a repeated document comes as so many rows. NULL and empty texts go, a NULL
    source is a source."""
    with _turn(spark, sf_dir):
        return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the pieces of the documents in sequences of the capacity; rows that share an id are packed each on its own."""
    with _turn(spark, sf_dir):
        return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's input is deleted when its result is written; the last one's stays for the lazy result."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        df = stage(spark, docs, sf_dir)
        path = scratch_path(spark, "pipeline")
        df.write.parquet(path)
        docs = spark.read.schema(df.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
