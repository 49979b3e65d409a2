"""Streaming forms of the exception reports, lateness, and refresh on new data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanewise.plans.reports import cascade_sources, cascade_totals
from lanewise.sources.folders import subfolders

MONDAY = "4 days"  # from 1970-01-01, a Thursday, to the first Monday


def exception_windows(events: DataFrame, by: str, width: str = "1 day", start: str = "0 days", delay: str = "2 days") -> DataFrame:
    """Events and exceptions per window of event time and per ``by`` (a carrier or port column).

    Seven-day windows with ``start=MONDAY`` are ISO weeks. On a stream, a window is emitted once the
    watermark has passed it.
    """
    grouped = events.withWatermark("event_time", delay).groupBy(F.window("event_time", width, width, start), by)
    return grouped.agg(F.count("*").alias("total_events"), F.count_if("is_exception").alias("exception_count")).select(
        by, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "total_events", "exception_count"
    )


def with_lag(events: DataFrame) -> DataFrame:
    """Seconds between an event and its recording."""
    return events.withColumn("lag_seconds", F.timestamp_diff("SECOND", F.col("event_time"), F.col("recorded_at")))


def split_late(events: DataFrame, allowed_hours: int) -> tuple[DataFrame, DataFrame]:
    """(in time, late): an event is late when recorded more than ``allowed_hours`` after it happened."""
    late = F.col("recorded_at") > F.col("event_time") + F.make_dt_interval(hours=F.lit(allowed_hours))
    late = F.coalesce(late, F.lit(False))
    return events.filter(~late), events.filter(late)


class CascadeMonitor:
    """Cascades over a stream of events.

    A new exception can change only the pairs of own exceptions in the ``hours`` before it, and begins pairs of its own with those
    in the ``hours`` after it. So a micro-batch counts anew the own exceptions of the days in that reach, each
    with all later ones in its window, from the exception log's days around them; nothing else is read, however long the log.
    Output is a row per (shipment, own exception instant); of several batches' rows for one, the last counts
    (``latest``), so totals over any stretch are those of the batch report. Days are UTC and are found in Spark.
    """

    def __init__(self, root: str, shipments: Callable[[], DataFrame], hours: int = 48):
        self.root, self.shipments, self.hours = root.rstrip("/"), shipments, hours

    def _replace(self, df: DataFrame, sink: str, batch: int) -> None:
        """Write rows with a ``day`` under day and batch; a replayed batch replaces its own."""
        rows = df.withColumn("batch", F.lit(batch).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.root}/{sink}")

    def _days(self, spark: SparkSession, sink: str, schema: str, days: set[int]) -> DataFrame:
        folder = f"{self.root}/{sink}"
        there = [d for d in subfolders(spark, folder) if int(d.removeprefix("day=")) in days]
        read = spark.read.option("basePath", folder).schema(schema)
        return read.parquet(*[f"{folder}/{d}" for d in there]) if there else spark.createDataFrame([], schema)

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark, reach = events.sparkSession, -(-self.hours // 24)
        failed = events.filter("is_exception AND event_time IS NOT NULL").select("shipment_id", "event_time", "is_exception", day_of(F.col("event_time")).alias("day"))
        self._replace(failed, "exceptions", batch)
        days = {r["day"] for r in failed.select("day").distinct().collect()}  # one number a day
        if not days:
            return
        own = {d - k for d in days for k in range(reach + 1)}
        near = {d + k for d in own for k in range(reach + 1)}
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in failed.schema) + ", batch long"
        log = self._days(spark, "exceptions", schema, near).filter(F.col("batch") <= batch)
        counted = cascade_sources(log.select("shipment_id", "event_time", "is_exception"), self.shipments(), None, 0, self.hours)
        counted = counted.withColumn("day", day_of(F.timestamp_micros("at"))).filter(F.col("day").isin(*own))
        self._replace(counted, "sources", batch)

    def latest(self, spark: SparkSession) -> DataFrame:
        """The pairs of each shipment and own exception instant, as the last batch that reached it counted them."""
        rows = spark.read.parquet(f"{self.root}/sources")
        return latest_sources(rows)

    def totals(self, spark: SparkSession) -> DataFrame:
        """The cascades of all exceptions so far, equal to ``reports.cascades`` over them."""
        return cascade_totals(self.latest(spark))


def day_of(instant: Column) -> Column:
    """The UTC day's number, whatever the session's or the driver's time zone."""
    return F.floor(F.unix_micros(instant) / F.lit(86_400_000_000)).cast("int")


def latest_sources(rows: DataFrame) -> DataFrame:
    """Of the rows of one shipment and instant, that of the last batch."""
    values = F.struct("pairs", "seen")
    found = rows.groupBy("shipment_id", "route_id", "at").agg(F.max_by(values, "batch").alias("last"))
    return found.select("shipment_id", "route_id", "at", "last.pairs", "last.seen")


def start(events: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run a micro-batch handler over a stream; by default until the input is drained."""
    writer = events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def refresh_when_new(events: DataFrame, refresh: Callable[[], object], checkpoint: str) -> StreamingQuery:
    """Call ``refresh`` once for each micro-batch that has rows; with a scheduler, each run drains what is new."""

    def handler(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh()

    return start(events, handler, checkpoint)
