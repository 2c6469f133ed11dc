"""The metrics sink: one row a run, as CSV or as aligned text, and a stopwatch."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession


class Stopwatch:
    """Milliseconds of a block, 1 at least."""

    def __enter__(self) -> Stopwatch:
        self._began, self.ms = time.perf_counter(), 1
        return self

    def __exit__(self, *_: object) -> None:
        self.ms = max(1, int((time.perf_counter() - self._began) * 1000))


def log_row(spark: SparkSession, **values: object) -> DataFrame:
    """One row; several values of a field become one quoted text."""
    row = {k: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else v for k, v in values.items()}
    return spark.createDataFrame([tuple(row.values())], list(row))


def write_log(row: DataFrame, path: str, header: bool = True) -> None:
    row.write.mode("append").option("header", header).option("quoteAll", False).csv(path)


def aligned(row: DataFrame) -> str:
    r = row.first().asDict()
    width = max(map(len, r))
    return "\n".join(f"{k + ':':<{width + 1}} {v}" for k, v in r.items())
