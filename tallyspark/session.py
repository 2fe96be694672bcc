"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tallyspark.plans.staging import local_folder


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench. The checkpoint folder stands in for the
    shared folder a cluster names in ``spark.checkpoint.dir``."""
    folder = os.environ.get("TALLYSPARK_SHARED") or local_folder()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
