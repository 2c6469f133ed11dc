"""Session helper for tests, the bench and local runs. On a cluster the caller's session is used as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local[cpus] session in UTC with adaptive execution on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gristmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "GRISTMILL_WAREHOUSE" in os.environ:
        builder = builder.config("spark.sql.warehouse.dir", os.environ["GRISTMILL_WAREHOUSE"])
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
