"""Grouped counts over files as they come: each micro-batch adds partial states, and reading merges them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.operators.aggregate import AggSpec, merge, partial


def run_available(spark: SparkSession, folder: str, schema, spec: AggSpec, states: str, checkpoint: str, files: int = 1) -> None:
    """Aggregate all files of ``folder`` that haven't been, ``files`` to a batch. A repeated batch replaces its states."""

    def add(batch: DataFrame, number: int) -> None:
        partial(batch, spec).write.mode("overwrite").parquet(f"{states}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, spec: AggSpec, states: str) -> DataFrame:
    return merge(spark.read.parquet(states), spec)
