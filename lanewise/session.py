"""Session helpers. The library never fixes partition counts: those are the cluster's to set."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", app: str = "lanewise") -> SparkSession:
    """A session for tests and the local bench only."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def pin_utc(spark: SparkSession) -> SparkSession:
    """All instants in the data model are UTC, so day, week and month bounds are UTC bounds."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
