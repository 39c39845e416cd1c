"""A session for tests, checks and single machines."""

import os

from pyspark.sql import SparkSession


def session(name: str = "pagelode", cores: str | int = "8") -> SparkSession:
    """A local session. On a cluster use the one that ``spark-submit`` configures."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
