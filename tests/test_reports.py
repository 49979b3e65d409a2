"""Reports on hand-made rows: the double counting as published, the corrected twin, and the edges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from freight import AS_OF
from pyspark.sql import functions as F

from lanewise.plans import matviews, reports, snapshots

LATE = {"estimated_arrival": "2024-02-25"}


def test_carrier_performance_counts_cargo_lines(table):
    shipments = table("shipments", {**LATE, "declared_value": Decimal("100")}, {"declared_value": Decimal("400")}, {"declared_value": None})
    cargo = table("cargo", {}, {}, {})
    carriers = table("carriers", {"id": "ca1"})
    row = reports.carrier_performance_summary(shipments, cargo, carriers, AS_OF).first()
    assert (row["shipment_count"], row["delay_rate_pct"], row["avg_declared_value"]) == (5, Decimal("0.00"), Decimal("175.00"))
    assert row["total_gross_weight_kg"] == Decimal("3000.000")
    row = reports.carrier_performance_summary_corrected(shipments, cargo, carriers, AS_OF).first()
    assert (row["shipment_count"], row["delay_rate_pct"], row["avg_declared_value"]) == (3, Decimal("33.33"), Decimal("250.00"))
    assert row["total_gross_weight_kg"] == Decimal("3000.000")


def test_delay_rate_is_all_or_nothing_as_published(table):
    carriers = table("carriers", {"id": "ca1"})
    row = reports.carrier_performance_summary(table("shipments", LATE, {**LATE, "declared_value": None}), table("cargo", {"shipment_id": "x"}), carriers, AS_OF).first()
    assert row["delay_rate_pct"] == Decimal("100.00")


def test_leaderboard_ranks_without_gaps(table):
    shipments = table("shipments", {"carrier_id": "b"}, {"carrier_id": "a"}, {"carrier_id": "c"}, {"carrier_id": "c"})
    carriers = table("carriers", *[{"id": c} for c in "abc"])
    board = reports.carrier_leaderboard(shipments, table("cargo", {}), carriers, AS_OF).orderBy("volume_rank").collect()
    assert [(r["carrier_id"], r["volume_rank"]) for r in board] == [("c", 1), ("a", 2), ("b", 3)]


def test_dashboard(table):
    none = reports.dashboard_summary(table("shipments", {}).filter("false"), AS_OF).first()
    assert tuple(none) == (0, 0, 0, Decimal("0.00"))
    some = reports.dashboard_summary(table("shipments", LATE, {"status": "EXCEPTION", **LATE}, {"status": "CANCELLED", **LATE}), AS_OF).first()
    assert tuple(some) == (3, 1, 2, Decimal("30000.00"))


def test_month_bounds_are_utc(table):
    trend = reports.monthly_volume_trend(table("shipments", {"departure_date": "2024-01-31 23:59:59.999999"}, {"departure_date": "2024-02-01"}, {"departure_date": None, "declared_value": None}))
    assert [(str(r["month"]), r["shipment_count"]) for r in trend.collect()] == [("2024-01-01", 1), ("2024-02-01", 1)]


def test_route_without_arrivals_has_zero_transit(table):
    row = reports.route_utilization(table("shipments", {}, LATE), table("routes", {"id": "r1"}), AS_OF).first()
    assert (row["avg_transit_days"], row["delay_count"]) == (timedelta(0), 1)
    row = reports.route_utilization(table("shipments", {"actual_arrival": "2024-02-25 12:00:00"}, {"actual_arrival": "2024-02-26 12:00:00"}), table("routes", {"id": "r1"}), AS_OF).first()
    assert row["avg_transit_days"] == timedelta(days=2, hours=12)


def test_on_time_rate_counts_undelivered_rows(table):
    done = {"status": "DELIVERED", "actual_arrival": "2024-03-15 12:00:00"}
    df = table("shipments", done, {**done, "actual_arrival": "2024-03-16"}, {})
    assert reports.on_time_rate(df, "carrier_id").first()["on_time_rate"] == Decimal("33.33")
    assert reports.on_time_rate(df).first()["on_time_rate"] == Decimal("33.33")


def test_percentiles_interpolate_and_hide_zero(table):
    def done(carrier: str, hours: float) -> dict:
        arrived = datetime(2024, 2, 1) + timedelta(hours=hours)
        return {"carrier_id": carrier, "status": "DELIVERED", "departure_date": "2024-02-01", "actual_arrival": str(arrived)}

    df = table("shipments", *[done("a", h) for h in (24, 48, 48, 240)], done("z", 0), {"carrier_id": "open"})
    rows = {r["carrier_id"]: r for r in reports.transit_percentiles(df).collect()}
    assert set(rows) == {"a", "z"}
    assert rows["a"]["median_days"] == 2.0 and rows["a"]["p95_days"] == pytest.approx(2 + 0.85 * 8) and rows["a"]["sample_size"] == 4
    assert rows["z"]["median_days"] is None and rows["z"]["sample_size"] == 1
    near = {r["carrier_id"]: r["median_days"] for r in reports.transit_percentiles_approx(df).collect()}
    assert near["a"] == 2.0


def test_top_lanes_arguments_and_ties(table):
    shipments = table("shipments", {"route_id": "r2"}, {"route_id": "r1"}, {"route_id": "r3", "departure_date": "2023-01-01"})
    routes = table("routes", *[{"id": r} for r in ("r1", "r2", "r3")])
    calls = table("port_calls", {"route_id": "r2"})
    got = reports.top_lanes_by_volume(shipments, routes, calls, AS_OF, limit=5, days=90).collect()
    assert [(r["route_id"], r["latest_delay_hours"]) for r in got] == [("r1", None), ("r2", Decimal("1.00"))]
    for bad in ({"limit": 0}, {"limit": 101}, {"days": 366}, {"days": 1.5}):
        with pytest.raises(ValueError):
            reports.top_lanes_by_volume(shipments, routes, calls, AS_OF, **bad)


def _cascade(events: list[tuple], lanes: dict) -> dict:
    """The pairs, counted directly."""
    out: dict = {}
    for ship, at in events:
        if ship not in lanes:
            continue
        later = [t for other, t in events if other != ship and lanes.get(other) == lanes[ship] and at < t <= at + timedelta(hours=48)]
        if later:
            n, first, last = out.get(ship, (0, at, at))
            out[ship] = (n + len(later), min(first, at), max(last, *later))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_cascades_match_the_pairs(spark, table, seed):
    rng = random.Random(seed)
    lanes = {f"s{n}": rng.choice(["r1", "r1", "r2"]) for n in range(8)}
    events = [(f"s{rng.randrange(9)}", datetime(2024, 2, 1) + timedelta(hours=12 * rng.randrange(24))) for _ in range(60)]
    shipments = table("shipments", *[{"id": s, "route_id": r} for s, r in lanes.items()])
    log = table("tracking_events", *[{"shipment_id": s, "event_time": str(t), "is_exception": True} for s, t in events], {"shipment_id": "s1"})
    got = reports.cascades(log, shipments, "2024-03-01 00:00:00", 365, 48).collect()
    found = {r["shipment_id"]: (r["cascade_exception_count"], r["first_exception_time"], r["last_cascade_time"]) for r in got}
    assert found == _cascade(events, lanes)


def test_hot_route_is_linear(spark):
    """20 000 shipments fail one second apart on one route: 2 * 10^8 pairs, none of them built."""
    n = 20_000
    shipments = spark.range(n).select("id", F.lit(1).alias("route_id"))
    events = spark.range(n).select(F.col("id").alias("shipment_id"), F.lit(True).alias("is_exception"), F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("event_time"))
    found = reports.cascades(events, shipments, None, 0, 48)
    last = F.timestamp_seconds(F.lit(1_700_000_000 + n - 1))
    row = found.agg(F.sum("cascade_exception_count").alias("pairs"), F.count("*").alias("n"), F.count_if(F.col("last_cascade_time") == last).alias("to_the_end")).first()
    assert tuple(row) == (n * (n - 1) // 2, n - 1, n - 1)


def test_cascade_edges(table):
    shipments = table("shipments", {"id": "a"}, {"id": "b"}, {"id": "c"})
    at = {"a": ["2024-02-10 00:00:00"], "b": ["2024-02-10 00:00:00", "2024-02-12 00:00:00"], "c": ["2024-02-12 00:00:01", "2024-02-11 00:00:00"]}
    log = table("tracking_events", *[{"shipment_id": s, "event_time": t, "is_exception": True} for s, times in at.items() for t in times])
    got = reports.exception_cascades(log, shipments, AS_OF, days=30).collect()
    # a sees b at exactly +48 h and c at +24 h, but neither b at +0 h nor c a second after the window
    assert {r["shipment_id"]: r["cascade_exception_count"] for r in got} == {"a": 2, "b": 2}
    assert [str(r["last_cascade_time"]) for r in got if r["shipment_id"] == "a"] == ["2024-02-12 00:00:00"]


def test_daily_stats_fan_out_as_published(table):
    shipments = table("shipments", {**LATE, "declared_value": Decimal("100")}, {"declared_value": Decimal("300")})
    cargo = table("cargo", {})
    events = table("tracking_events", {}, {"is_exception": True})
    row = matviews.carrier_daily_stats(shipments, cargo, events, AS_OF).first()
    assert (row["shipment_count"], row["delay_count"], row["exception_count"]) == (3, 2, 1)
    assert (row["avg_declared_value"], row["total_weight_kg"]) == (Decimal("166.666667"), Decimal("2000.000"))
    row = matviews.carrier_daily_stats_corrected(shipments, cargo, events, AS_OF).first()
    assert (row["shipment_count"], row["delay_count"], row["exception_count"]) == (2, 1, 1)
    assert (row["avg_declared_value"], row["total_weight_kg"]) == (Decimal("200.000000"), Decimal("1000.000"))


def test_monthly_performance_without_deliveries(table):
    row = matviews.route_monthly_performance(table("shipments", {"declared_value": None})).first()
    assert (row["on_time_rate_pct"], row["avg_transit_days"], row["total_declared_value"]) == (None, None, Decimal("0.00"))


def test_congestion_edges_and_weeks(table):
    calls = table("port_calls", {"scheduled_arrival": "2024-02-25 23:00:00", "arrival_delay_hours": Decimal("4")}, {"scheduled_arrival": "2024-02-26 00:00:00", "arrival_delay_hours": None}, {"scheduled_arrival": None})
    at = ["2024-02-23 23:00:00", "2024-02-27 23:00:00", "2024-02-23 22:59:59", "2024-02-28 00:00:00"]
    events = table("tracking_events", *[{"port_id": "p1", "event_time": t, "is_exception": n == 0} for n, t in enumerate(at)], {"port_id": None})
    rows = {str(r["stat_week"]): r for r in matviews.port_congestion(calls, events).collect()}
    sunday, monday = rows["2024-02-19"], rows["2024-02-26"]
    assert (sunday["arrival_count"], sunday["avg_delay_hours"], sunday["exception_rate_pct"]) == (2, Decimal("4.000000"), Decimal("50.000000"))
    assert (monday["arrival_count"], monday["avg_delay_hours"], monday["exception_rate_pct"]) == (2, None, Decimal("0.000000"))
    alone = matviews.port_congestion(calls, events.filter("false")).collect()
    assert {(r["arrival_count"], r["exception_rate_pct"]) for r in alone} == {(1, None)}


def test_snapshots(table):
    day = {"departure_date": "2024-02-29 23:00:00"}
    shipments = table("shipments", {**day, **{"estimated_arrival": "2024-03-01"}}, {**day, "declared_value": None}, {"carrier_id": "off", **day}, {"departure_date": "2024-03-01 00:00:00"})
    carriers = table("carriers", {"id": "ca1"}, {"id": "off", "is_active": False}, {"id": "idle"})
    got = {r["metric_key"]: r["metric_value"] for r in snapshots.carrier_snapshots(shipments, carriers, "2024-02-29", AS_OF).collect()}
    assert got == {"shipments.count": 2, "shipments.delay_count": 1, "shipments.avg_declared_value": 10000}
    routes = table("routes", {"id": "r1"}, {"id": "r2"})
    month = snapshots.route_snapshots(shipments, routes, "2024-02-29").collect()
    assert [(str(r["snapshot_date"]), r["metric_value"]) for r in month] == [("2024-02-01", 3)]
    quiet = snapshots.global_snapshots(shipments, "2020-01-01", AS_OF).collect()
    assert len(quiet) == 4 and {r["metric_value"] for r in quiet} == {0} and {r["entity_id"] for r in quiet} == {None}


def test_read_port_congestion_puts_unknown_delays_last(spark):
    rows = [("a", "2024-02-26", 1, None), ("b", "2024-02-26", 1, Decimal("2.345000")), ("c", "2024-01-01", 9, Decimal("9"))]
    df = spark.createDataFrame(rows, "port_id string, w string, arrival_count bigint, avg_delay_hours decimal(28,6)")
    df = df.select("port_id", F.to_date("w").alias("stat_week"), "arrival_count", "avg_delay_hours", F.lit(None).cast("decimal(28,6)").alias("exception_rate_pct"))
    got = reports.read_port_congestion(df, AS_OF).collect()
    assert [(r["port_id"], r["avg_delay_hours"]) for r in got] == [("b", Decimal("2.35")), ("a", None)]
