"""Scratch tables in the folder the cluster shares, and small column helpers of the text operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else is part of a word.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """A new name below ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder; on a cluster a machine-local
    folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="lanewise-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


#: Spark then deletes the shuffle files of a write when the write has ended, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of rows that go to a Python worker at once; each executor core holds a few times as many outside the heap.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


#: For tables whose rows have megabytes: few rows to a Python worker and few decoded at once. As given, an executor holds all rows of a
#: task in each of its buffers, inside and outside the heap.
WIDE_ROWS = {BATCH_BYTES: "4m", "spark.sql.parquet.columnarReaderBatchSize": "8"}
#: Pages are else closed after 100 rows at the soonest and packed whole, in buffers that stay with the executor.
_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "100"}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries that run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def stored(df: DataFrame, folder: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: what follows starts there, also after a lost executor.

    ``batch_rows``: rows that a Python worker gets at once while writing, for rows that are large.
    """
    spark = df.sparkSession
    path = folder or shared_folder(spark)
    with settings(spark, {CLEANUP: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})):
        df.write.mode("overwrite").options(**_PAGES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other alphabets)."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; -1 for null, which is no one's fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))
