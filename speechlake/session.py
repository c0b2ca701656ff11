"""Session settings used by the tests, the benchmark and local runs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings a cluster session should also carry.

    On a cluster only the master, memory and partition counts change: adaptive
    execution, skew-join splitting and the UTC clock stay as they are here. The
    shared folder is SPEECHLAKE_SHARED, else a new one on this machine.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("speechlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("SPEECHLAKE_SHARED") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
