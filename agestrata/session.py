"""Session settings used by the bench, the tests and local runs."""

import os

from pyspark.sql import SparkSession


def local_session(app: str = "agestrata", cpus: str | int = "*", partitions: int = 8):
    """A local session. On a cluster, pass your own session to the library."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Groups that are gathered as arrays stay in a hash table on the map side: beyond
        # this number of them the rows would be sorted first.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
        .config("spark.driver.memory", os.environ.get("AGESTRATA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        # Recording the Python line of every Column call costs more than small queries.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
