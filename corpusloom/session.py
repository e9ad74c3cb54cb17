"""Session construction for tests, the bench and interactive use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, app: str = "corpusloom", **conf: str) -> SparkSession:
    """A local session with the settings every operator here assumes (UTC, AQE, Arrow).

    On a cluster the session is made by the cluster; nothing in the library calls this.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS") or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", conf.pop("checkpoint_dir", None) or tempfile.mkdtemp(prefix="corpusloom-"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
