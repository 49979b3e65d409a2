"""Jobs a scheduler calls: refresh the materialized views, populate the metric snapshots."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.plans import matviews, snapshots
from lanewise.sources.periods import PeriodTable
from lanewise.sources.snapshot_store import SnapshotStore

# how often each view is due, for the scheduler's table
CADENCE = {
    "mv_carrier_daily_stats": "every 15 minutes",
    "mv_port_congestion": "hourly",
    "mv_route_monthly_performance": "daily at 02:00 UTC",
}


@dataclass(frozen=True)
class Freight:
    """The tables the jobs read."""

    shipments: DataFrame
    cargo: DataFrame
    tracking_events: DataFrame
    port_calls: DataFrame
    carriers: DataFrame
    routes: DataFrame


def build_view(name: str, tables: Freight, as_of: str) -> DataFrame:
    builders: dict[str, Callable[[], DataFrame]] = {
        "mv_carrier_daily_stats": lambda: matviews.carrier_daily_stats(tables.shipments, tables.cargo, tables.tracking_events, as_of),
        "mv_route_monthly_performance": lambda: matviews.route_monthly_performance(tables.shipments),
        "mv_port_congestion": lambda: matviews.port_congestion(tables.port_calls, tables.tracking_events),
    }
    if name not in builders:
        raise ValueError(f"unknown view {name!r}; known: {sorted(builders)}")
    return builders[name]()


# view -> its period column and unit
PERIODS = {
    "mv_carrier_daily_stats": ("stat_date", "month"),
    "mv_route_monthly_performance": ("stat_month", "month"),
    "mv_port_congestion": ("stat_week", "week"),
}


def view_table(spark: SparkSession, root: str, name: str) -> PeriodTable:
    if name not in matviews.KEYS:
        raise ValueError(f"unknown view {name!r}; known: {sorted(matviews.KEYS)}")
    return PeriodTable(spark, f"{root}/{name}", matviews.KEYS[name], *PERIODS[name])


def refresh_views(spark: SparkSession, root: str, tables: Freight, as_of: str, view: str = "ALL") -> dict:
    """Rebuild one view or all of them. Returns the exact row count of each."""
    names = list(matviews.KEYS) if view == "ALL" else [view]
    done = {name: view_table(spark, root, name).publish(build_view(name, tables, as_of))["rows"] for name in names}
    return {"refreshed": list(done), "rows": done, "status": "ok"}


def refresh_periods(spark: SparkSession, root: str, tables: Freight, as_of: str, view: str, periods: list[str]) -> dict:
    """Rebuild the given periods (their first days) of a view and leave all others as they are.

    The time column of the fact table is cut to the periods with literal bounds, which reach the scan (and prune it where the
    table is laid out by time); cargo and events are cut to the shipments, or to the days around the port calls, before they are totalled.
    """
    table = view_table(spark, root, view)
    unit = PERIODS[view][1]
    # period by period for single ones, so that two far apart do not read what lies between
    within = lambda column: reduce(lambda a, b: a | b, [(F.col(column) >= F.lit(p).cast("timestamp")) & (F.col(column) < F.lit(_after(p, unit)).cast("timestamp")) for p in periods])
    if not periods:
        return {"version": table.current(), "rows": 0, "periods": []}
    if view == "mv_port_congestion":
        calls = tables.port_calls.filter(within("scheduled_arrival"))
        near = reduce(lambda a, b: a | b, [F.col("event_time").between(F.lit(_shifted(p, -3)).cast("timestamp"), F.lit(_shifted(_after(p, unit), 3)).cast("timestamp")) for p in periods])
        fresh = matviews.port_congestion(calls, tables.tracking_events.filter(near))
    else:
        part = tables.shipments.filter(within("departure_date"))
        ids = part.select(F.col("id").alias("shipment_id"))
        children = [t.join(ids, "shipment_id", "left_semi") for t in (tables.cargo, tables.tracking_events)]
        fresh = build_view(view, replace(tables, shipments=part, cargo=children[0], tracking_events=children[1]), as_of)
    return table.publish(fresh, periods)


def _shifted(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def _after(period: str, unit: str) -> str:
    """The first day of the next period."""
    if unit == "week":
        return _shifted(period, 7)
    first = date.fromisoformat(period)
    return date(first.year + first.month // 12, first.month % 12 + 1, 1).isoformat()


def refresh_carrier_days(spark: SparkSession, root: str, tables: Freight, as_of: str, touched: DataFrame) -> dict:
    """Rebuild the months of the (carrier_id, stat_date) keys in ``touched``; a key without shipments left disappears."""
    table = view_table(spark, root, "mv_carrier_daily_stats")
    months = touched.select(table.period_of(F.col("stat_date")).alias("month")).dropna().distinct().collect()  # a row a month
    return refresh_periods(spark, root, tables, as_of, "mv_carrier_daily_stats", sorted(r["month"] for r in months))


def populate_snapshots(spark: SparkSession, root: str, tables: Freight, as_of: str, day: str | None = None, entity_type: str = "ALL") -> dict:
    """Write the snapshots of a date (default: the day before ``as_of``).

    With ALL, one failing entity type does not stop the others and the status is ``partial``; a single
    entity type raises.
    """
    if entity_type not in ("CARRIER", "ROUTE", "GLOBAL", "ALL"):
        raise ValueError(f"unknown entity type {entity_type!r}")
    day = day or (date.fromisoformat(as_of[:10]) - timedelta(days=1)).isoformat()
    month = date.fromisoformat(day).replace(day=1).isoformat()
    store = SnapshotStore(spark, root)
    steps: dict[str, tuple[str, Callable[[], DataFrame]]] = {
        "CARRIER": (day, lambda: snapshots.carrier_snapshots(tables.shipments, tables.carriers, day, as_of)),
        "ROUTE": (month, lambda: snapshots.route_snapshots(tables.shipments, tables.routes, day)),
        "GLOBAL": (day, lambda: snapshots.global_snapshots(tables.shipments, day, as_of)),
    }
    upserted, errors = 0, []
    for name, (where, build) in steps.items():
        if entity_type not in (name, "ALL"):
            continue
        try:
            upserted += store.upsert(where, build())
        except Exception as error:
            if entity_type != "ALL":
                raise RuntimeError(f"snapshots failed for {name}: {error}") from error
            errors.append(f"{name}: {error}")
    return {"date": day, "entity_type": entity_type, "upserted": upserted, "errors": errors, "status": "partial" if errors else "ok"}
