"""Store of metric snapshots, one versioned dataset per snapshot date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from lanewise.plans.snapshots import KEY
from lanewise.sources.tables import first_per_key
from lanewise.sources.versions import VersionedTable


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _day(self, day: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/snapshot_date={day}", KEY)

    def upsert(self, day: str, rows: DataFrame) -> int:
        """Insert or replace the metrics of one date; running it again changes nothing. Returns rows upserted.

        Only that date is rewritten. GLOBAL rows have no entity id, so keys compare null-safe.
        """
        rows = first_per_key(rows, KEY, ["id"]).persist()
        try:
            upserted = rows.count()
            if upserted:
                self._day(day).publish_touched(rows)
            return upserted
        finally:
            rows.unpersist()

    def read(self, *days: str) -> DataFrame:
        return reduce(lambda a, b: a.unionByName(b), [self._day(day).read() for day in days])
