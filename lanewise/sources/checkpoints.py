"""Cutting a long lineage with a checkpoint in the folder the cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back, so plans built on it start there.

    The folder is the session's (``spark.checkpoint.dir``). Only a local-mode session without one gets a
    temporary folder; on a cluster a machine-local folder would be lost with its machine. Spark removes a checkpoint when no frame
    refers to it any more if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true, as it should be.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return shared or tempfile.mkdtemp(prefix="lanewise-checkpoint-")


def run_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, for datasets of one run."""
    return f"{shared_folder(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffle_files_deleted(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside are deleted when the write has ended, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
