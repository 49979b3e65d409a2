"""Materialized aggregates: one batch job per view, each a plain DataFrame keyed by (entity, period).

Each view is a finish of its parts: exact sums and counts per key, with ``live``, the number of fact rows behind them. Parts of disjoint facts
add up and can be taken back, so a change needs the changed facts only: the parts of their new versions are added to the kept ones, those of
the old versions subtracted (:func:`with_changes`). Keys without live rows go.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import columns as C
from lanewise.operators import joins
from lanewise.operators.intervals import counts_in_ranges

# view name -> columns that identify a row
KEYS = {
    "mv_carrier_daily_stats": ["carrier_id", "stat_date"],
    "mv_route_monthly_performance": ["route_id", "stat_month"],
    "mv_port_congestion": ["port_id", "stat_week"],
}


def carrier_daily_stats(shipments: DataFrame, cargo: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """As published: each shipment counts once per tracking event (once when it has none); only
    the exception count is free of that weighting."""
    return carrier_daily_finish(carrier_daily_parts(shipments, cargo, events, as_of))


def carrier_daily_stats_corrected(shipments: DataFrame, cargo: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Each shipment counts once."""
    return carrier_daily_finish(carrier_daily_parts(shipments, cargo, events, as_of, corrected=True))


def carrier_daily_parts(shipments: DataFrame, cargo: DataFrame, events: DataFrame, as_of: str, corrected: bool = False) -> DataFrame:
    """A fact is a shipment with its cargo and events. Parts that are added up must share ``as_of``, which decides what is late."""
    times = F.lit(1).cast("long") if corrected else F.greatest(F.coalesce("event_rows", F.lit(1)), F.lit(1))
    weights = joins.cargo_totals(cargo).select(F.col("shipment_id").alias("id"), "total_gross_weight_kg")
    signals = joins.event_totals(events).select(F.col("shipment_id").alias("id"), "event_rows", "exception_rows")
    departed = shipments.filter("departure_date IS NOT NULL").select(
        "id", "carrier_id", F.to_date("departure_date").alias("stat_date"), "declared_value", C.is_delayed(as_of).alias("_late")
    )
    rows = departed.join(weights, "id", "left").join(signals, "id", "left").withColumn("_times", times)
    exact = F.col("_times").cast("decimal(10,0)")
    return rows.groupBy("carrier_id", "stat_date").agg(
        F.count(F.lit(1)).alias("live"),
        F.sum("_times").alias("shipment_count"),
        F.sum(F.col("_late") * F.col("_times")).alias("delay_count"),
        F.sum(F.col("declared_value") * exact).alias("_value"),
        F.sum(F.when(F.col("declared_value").isNotNull(), F.col("_times"))).alias("_valued"),
        F.sum(F.col("total_gross_weight_kg") * exact).alias("_weight"),
        F.coalesce(F.sum("exception_rows"), F.lit(0)).alias("exception_count"),
    )


def carrier_daily_finish(parts: DataFrame) -> DataFrame:
    return parts.select(
        "carrier_id",
        "stat_date",
        "shipment_count",
        "delay_count",
        C.ratio(F.col("_value"), F.col("_valued"), 6).alias("avg_declared_value"),
        F.coalesce(F.col("_weight").cast("decimal(24,3)"), F.lit(Decimal(0)).cast("decimal(24,3)")).alias("total_weight_kg"),
        "exception_count",
    )


def route_monthly_performance(shipments: DataFrame) -> DataFrame:
    """Per route and month: volume, mean transit days, on-time share of delivered shipments, value."""
    return route_monthly_finish(route_monthly_parts(shipments))


def route_monthly_parts(shipments: DataFrame) -> DataFrame:
    """A fact is a shipment."""
    micros = C.elapsed_micros(F.col("actual_arrival"), F.col("departure_date"))
    departed = shipments.filter("departure_date IS NOT NULL")
    return departed.groupBy("route_id", C.month_start(F.to_date("departure_date")).alias("stat_month")).agg(
        F.count("*").alias("live"),
        F.count("*").alias("shipment_count"),
        F.sum(micros.cast("decimal(38,0)")).alias("_micros"),
        F.count(micros).alias("_arrived"),
        F.sum(C.is_on_time()).alias("_good"),
        F.count_if(F.col("status") == "DELIVERED").alias("_done"),
        F.sum("declared_value").alias("_value"),
    )


def route_monthly_finish(parts: DataFrame) -> DataFrame:
    days = C.ratio(F.col("_micros") / F.lit(1_000_000).cast("decimal(8,0)"), F.col("_arrived") * 86_400, 6)
    return parts.select(
        "route_id",
        "stat_month",
        "shipment_count",
        days.alias("avg_transit_days"),
        C.percent(F.col("_good"), F.col("_done"), 6).alias("on_time_rate_pct"),
        F.coalesce(F.col("_value").cast("decimal(24,2)"), F.lit(Decimal(0)).cast("decimal(24,2)")).alias("total_declared_value"),
    )


def port_congestion(port_calls: DataFrame, events: DataFrame) -> DataFrame:
    """As published: each port call counts once per event within two days of it at the port (once when
    there is none), in the arrival count and in the mean delay."""
    return congestion_finish(congestion_parts(port_calls, events))


def port_congestion_corrected(port_calls: DataFrame, events: DataFrame) -> DataFrame:
    """Each port call counts once; the exception share still covers every matched (call, event)."""
    return congestion_finish(congestion_parts(port_calls, events, corrected=True))


def congestion_parts(port_calls: DataFrame, events: DataFrame, corrected: bool = False) -> DataFrame:
    """A fact is a port call with the events around it: a changed event changes the calls at its port within two days of it, before and after."""
    times = F.lit(1).cast("long") if corrected else F.greatest(F.col("n"), F.lit(1))
    calls = port_calls.filter("scheduled_arrival IS NOT NULL").groupBy("port_id", "scheduled_arrival").agg(
        F.count("*").alias("_calls"), F.count("arrival_delay_hours").alias("_timed"), F.sum("arrival_delay_hours").alias("_delay")
    )
    seen = events.filter("port_id IS NOT NULL AND event_time IS NOT NULL").groupBy("port_id", F.unix_micros("event_time").alias("at")).agg(
        F.count("*").alias("n"), F.count_if("is_exception").alias("bad")
    )
    reach = F.lit(2 * 86_400_000_000)
    at = F.unix_micros("scheduled_arrival")
    counted = counts_in_ranges(calls, seen, ["port_id"], ["n", "bad"], at - reach, at + reach).withColumn("_times", times)
    exact = F.col("_times").cast("decimal(12,0)")
    week = F.to_date(F.date_trunc("week", "scheduled_arrival"))
    return counted.groupBy("port_id", week.alias("stat_week")).agg(
        F.sum("_calls").alias("live"),
        F.sum(F.col("_calls") * F.col("_times")).alias("arrival_count"),
        F.sum(F.col("_delay") * exact).alias("_hours"),
        F.sum(F.col("_timed") * F.col("_times")).alias("_timed"),
        F.sum(F.col("_calls") * F.col("n")).alias("_seen"),
        F.sum(F.col("_calls") * F.col("bad")).alias("_bad"),
    )


def congestion_finish(parts: DataFrame) -> DataFrame:
    return parts.select(
        "port_id",
        "stat_week",
        "arrival_count",
        C.ratio(F.col("_hours"), F.col("_timed"), 6).alias("avg_delay_hours"),
        C.percent(F.col("_bad"), F.col("_seen"), 6).alias("exception_rate_pct"),
    )


def with_changes(parts: DataFrame, gone: DataFrame, come: DataFrame, key: list[str]) -> DataFrame:
    """Parts after a change: those kept, less the parts of the facts' old versions, plus those of the new ones.

    ``gone`` and ``come`` are parts of the changed facts only: a new fact is in ``come``, a deleted one in ``gone``, a changed one in both.
    All sums are exact, so the result is that of building anew. A key whose facts are not all there to be taken back is an error of
    the caller's and shows as a negative ``live``.
    """
    measures = [c for c in parts.columns if c not in key]
    signed = [df.select(*key, *[(F.coalesce(F.col(c), F.lit(0)) * sign).cast(parts.schema[c].dataType).alias(c) for c in measures]) for df, sign in ((parts, 1), (gone, -1), (come, 1))]
    merged = signed[0].unionByName(signed[1]).unionByName(signed[2]).groupBy(*key).agg(*[F.sum(c).cast(parts.schema[c].dataType).alias(c) for c in measures])
    return merged.filter("live <> 0")
