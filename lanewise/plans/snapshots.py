"""Metric snapshots: (entity, date, granularity, metric) -> value rows, one aggregation per entity type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import columns as C
from lanewise.functions import domain

KEY = ["entity_type", "entity_id", "metric_key", "snapshot_date", "granularity"]
_VALUE = "decimal(20,6)"


def _rows(df: DataFrame, entity_type: str, entity_id: Column, day: Column, granularity: str, metrics: dict[str, Column]) -> DataFrame:
    """Turn metric columns into rows."""
    pairs = F.array(*[F.struct(F.lit(name).alias("key"), F.coalesce(value.cast(_VALUE), F.lit(0).cast(_VALUE)).alias("value")) for name, value in metrics.items()])
    long = df.withColumns({"_entity": entity_id.cast("string"), "_day": day}).select("_entity", "_day", F.explode(pairs).alias("m"))
    key = [F.lit(entity_type), F.col("_entity"), F.col("_day"), F.lit(granularity), F.col("m.key")]
    return long.select(
        C.hashed_id(F.lit(entity_type), F.coalesce("_entity", F.lit("")), F.col("_day"), F.lit(granularity), F.col("m.key")).alias("id"),
        *[c.alias(n) for c, n in zip(key, ["entity_type", "entity_id", "snapshot_date", "granularity", "metric_key"])],
        F.col("m.value").alias("metric_value"),
        F.lit("{}").alias("dimensions"),
    )


def _departing_on(shipments: DataFrame, day: Column) -> DataFrame:
    return shipments.filter(F.to_date("departure_date") == day)


def carrier_snapshots(shipments: DataFrame, carriers: DataFrame, day: str, as_of: str) -> DataFrame:
    """Three daily metrics for each active carrier with a departure that day."""
    day_ = F.to_date(F.lit(day))
    totals = _departing_on(shipments, day_).groupBy("carrier_id").agg(
        F.count("*").alias("n"),
        F.count_if(C.past_eta_in_snapshots(as_of)).alias("late"),
        F.sum("declared_value").alias("value"),
        F.count("declared_value").alias("valued"),
    )
    working = carriers.filter("is_active").select(F.col("id").alias("carrier_id"))
    metrics = {
        "shipments.count": F.col("n"),
        "shipments.delay_count": F.col("late"),
        "shipments.avg_declared_value": C.ratio(F.col("value"), F.col("valued"), 6),
    }
    return _rows(totals.join(working, "carrier_id", "left_semi"), "CARRIER", F.col("carrier_id"), day_, "DAILY", metrics)


def route_snapshots(shipments: DataFrame, routes: DataFrame, day: str) -> DataFrame:
    """Monthly shipment count of each ACTIVE route with a departure in the day's month."""
    day_ = F.to_date(F.lit(day))
    departed = F.to_date("departure_date")
    month = shipments.filter((departed >= C.month_start(day_)) & (departed <= C.month_end(day_)))
    totals = month.groupBy("route_id").agg(F.count("*").alias("n"))
    working = routes.filter("status = 'ACTIVE'").select(F.col("id").alias("route_id"))
    return _rows(totals.join(working, "route_id", "left_semi"), "ROUTE", F.col("route_id"), C.month_start(day_), "MONTHLY", {"shipments.count": F.col("n")})


def global_snapshots(shipments: DataFrame, day: str, as_of: str) -> DataFrame:
    """Four daily platform metrics, written even when they are 0."""
    day_ = F.to_date(F.lit(day))
    totals = _departing_on(shipments, day_).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status").isin(domain.ACTIVE_STATUSES)).alias("active"),
        F.count_if(C.past_eta_in_snapshots(as_of)).alias("late"),
        F.sum("declared_value").alias("value"),
    )
    metrics = {
        "platform.shipments.total": F.col("total"),
        "platform.shipments.active": F.col("active"),
        "platform.shipments.delayed": F.col("late"),
        "platform.declared_value.total": F.col("value"),
    }
    return _rows(totals, "GLOBAL", F.lit(None), day_, "DAILY", metrics)
