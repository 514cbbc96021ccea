"""Session settings the plans rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(master: str | None = None, name: str = "tracelake") -> SparkSession:
    """Session for local runs; on a cluster pass the settings through spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        cores = master[6:-1] if master.startswith("local[") else "8"
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("TRACELAKE_DRIVER_MEMORY", "12g"))
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        )
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plan building without a stack capture per call
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
