"""Versioned datasets: a refresh writes a new directory and publishes it with a marker file.

Readers take the newest published version, so a refresh never blocks or changes a running read, and
a failed refresh leaves only an unpublished directory. Paths go through Hadoop's file system API and
work on any storage Spark can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_MARKER = "_PUBLISHED"


class DuplicateKeyError(ValueError):
    """A refreshed dataset has two rows with one key."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _fs(self, path: str):
        where = self._hadoop.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _children(self) -> list[int]:
        fs, where = self._fs(self.path)
        if not fs.exists(where):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(where)]
        return sorted(int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit())

    def directory(self, version: int) -> str:
        return f"{self.path}/v-{version:08d}"

    def published(self, version: int) -> bool:
        fs, marker = self._fs(f"{self.directory(version)}/{_MARKER}")
        return fs.exists(marker)

    def current(self) -> int | None:
        return next((v for v in reversed(self._children()) if self.published(v)), None)

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"nothing published under {self.path}")
        return self.spark.read.parquet(self.directory(version))

    def publish(self, df: DataFrame) -> dict:
        """Write the next version, check that its key is unique, then publish it."""
        version = max(self._children(), default=0) + 1
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(self.directory(version))
        written = self.spark.read.parquet(self.directory(version))
        clash = written.groupBy(*self.key).count().filter("count > 1").limit(1).collect()
        if clash:
            raise DuplicateKeyError(f"{self.path}: more than one row for {clash[0].asDict()}")
        fs, marker = self._fs(f"{self.directory(version)}/{_MARKER}")
        fs.create(marker, False).close()
        return {"version": version, "rows": seen.get["rows"]}

    def publish_touched(self, fresh: DataFrame, touched: DataFrame | None = None) -> dict:
        """Publish a version where ``fresh`` rows replace stored rows of the same key (NULL equals NULL).

        With ``touched`` (key columns), stored rows of those keys go even if ``fresh`` has none for them.
        """
        if self.current() is None:
            return self.publish(fresh)
        return self.publish(replaced(self.read(), fresh, self.key, touched))


def replaced(stored: DataFrame, fresh: DataFrame, key: list[str], touched: DataFrame | None = None) -> DataFrame:
    """Stored rows with ``fresh`` rows in place of those whose key is touched (default: in ``fresh``); null-safe."""
    gone = (fresh if touched is None else touched).select(*[F.col(k).alias(f"_gone_{k}") for k in key])
    kept = stored.join(gone, [F.col(k).eqNullSafe(F.col(f"_gone_{k}")) for k in key], "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))
