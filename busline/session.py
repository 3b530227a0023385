"""Session defaults for local runs and tests; on a cluster the submitter's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, app: str = "busline", memory: str = "12g") -> SparkSession:
    """A local session with as many shuffle partitions as cores."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.driver.memory", os.environ.get("BUSLINE_DRIVER_MEMORY", memory))
    builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
