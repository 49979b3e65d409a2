from __future__ import annotations

from decimal import Decimal

import pytest
from freight import AS_OF, ids
from pyspark.sql import functions as F

from lanewise.functions import columns as C
from lanewise.operators import derive, filters, joins, paging, projections, quality
from lanewise.operators.filters import Principal, ShipmentCriteria


def test_active(table):
    df = table("shipments", {"status": "IN_TRANSIT"}, {"status": "DELIVERED"}, {"status": "CANCELLED"})
    assert ids(filters.active(df)) == {"s1"}


def test_delayed_needs_a_past_eta_and_an_open_status(table):
    late = {"departure_date": "2024-01-31", "estimated_arrival": "2024-02-25"}
    df = table("shipments", late, {**late, "status": "DELIVERED", "actual_arrival": "2024-02-28"}, {"estimated_arrival": None}, {**late, "status": "CUSTOMS_HOLD"}, {"estimated_arrival": AS_OF})
    assert ids(filters.delayed(df, AS_OF)) == {"s1", "s4"}
    flags = {r["id"]: r["is_delayed"] for r in derive.with_delay_flag(df, AS_OF).collect()}
    assert flags == {"s1": 1, "s2": 0, "s3": 0, "s4": 1, "s5": 0}


def test_high_value_wants_a_decimal(table):
    df = table("shipments", {"declared_value": Decimal("500")}, {"declared_value": Decimal("499.99")}, {"declared_value": None})
    assert ids(filters.high_value(df, Decimal("500"))) == {"s1"}
    with pytest.raises(TypeError):
        filters.high_value(df, 500.0)


def test_range_checks(table):
    df = table("shipments", {})
    for months in (0, 25, "3", True):
        with pytest.raises(ValueError):
            filters.trend_window(df, AS_OF, months)


def test_departure_before_is_midnight(table):
    df = table("shipments", {"departure_date": "2024-02-10 00:00:00"}, {"departure_date": "2024-02-10 09:00:00"})
    assert ids(filters.matching(df, ShipmentCriteria(departure_before="2024-02-10"), AS_OF)) == {"s1"}


def test_criteria_carrier_must_be_active(table):
    df = table("shipments", {"carrier_id": "ca1"}, {"carrier_id": "ca2"})
    carriers = table("carriers", {"id": "ca1"}, {"id": "ca2", "is_active": False})
    assert ids(filters.matching(df, ShipmentCriteria(carrier_id="ca1"), AS_OF, carriers)) == {"s1"}
    assert ids(filters.matching(df, ShipmentCriteria(carrier_id="ca2"), AS_OF, carriers)) == set()
    assert ids(filters.matching(df, ShipmentCriteria(), AS_OF)) == {"s1", "s2"}


def test_row_scope(table):
    df = table("shipments", {"shipper_id": "a"}, {"consignee_id": "a"}, {"shipper_id": "b"})
    assert ids(filters.visible_to_company(df, Principal(company_id="a"))) == {"s1", "s2"}
    assert ids(filters.visible_to_company(df, Principal())) == set()
    assert ids(filters.visible_to_company(df, Principal(is_staff=True))) == {"s1", "s2", "s3"}
    assert ids(filters.visible_to_carrier(df, Principal(carrier_id="ca1"))) == {"s1", "s2", "s3"}
    assert ids(filters.visible_to_carrier(df, Principal())) == set()


def test_json_has_sees_null_values(table):
    df = table("shipments", {"custom_attributes": '{"k":null}'}, {"custom_attributes": '{"k":"v"}'}, {"custom_attributes": "{}"})
    assert ids(filters.json_has(df, "custom_attributes", "k")) == {"s1", "s2"}
    assert ids(filters.json_equals(df, "custom_attributes", "k", "v")) == {"s2"}


def test_superseded_chain(table):
    events = table("tracking_events", {"id": "e1"}, {"id": "e2", "supersedes_id": "e1"}, {"id": "e3", "supersedes_id": "e2"})
    assert ids(filters.not_superseded(events)) == {"e3"}


def test_value_tiers(table):
    values = [Decimal("600000"), Decimal("150000"), Decimal("15000"), Decimal("5000"), None, Decimal("500000"), Decimal("10000")]
    df = table("shipments", *[{"declared_value": v} for v in values])
    tiers = [r["value_tier"] for r in derive.with_value_tier(df).orderBy("id").collect()]
    assert tiers == ["platinum", "gold", "silver", "standard", "standard", "platinum", "silver"]


def test_transit_duration_runs_on_until_arrival(table):
    df = table("shipments", {"departure_date": "2024-02-20 12:00:00", "actual_arrival": "2024-02-22 12:00:00"}, {"departure_date": "2024-02-28 12:00:00"})
    days = [r["transit_duration"].days for r in derive.with_transit_duration(df, AS_OF).orderBy("id").collect()]
    assert days == [2, 2]


def test_hours_overdue_truncate(table):
    df = table("shipments", {"estimated_arrival": "2024-03-01 06:01:00"})
    assert derive.with_hours_overdue(df, AS_OF).first()["hours_overdue"] == 5


def test_cargo_summary_does_not_fan_out(table):
    shipments = table("shipments", {}, {})
    cargo = table("cargo", {}, {"package_count": 5}, {"gross_weight_kg": Decimal("0.500")})
    rows = {r["id"]: (r["total_gross_weight_kg"], r["total_packages"]) for r in joins.with_cargo_summary(shipments, cargo).collect()}
    assert rows == {"s1": (Decimal("2000.500"), 25), "s2": (Decimal("0.000"), 0)}


def test_latest_port_call_and_route_without_calls(table):
    calls = table(
        "port_calls",
        {"arrival_delay_hours": Decimal("1")},
        {"arrival_delay_hours": None, "scheduled_arrival": "2024-02-21"},
        {"scheduled_arrival": None},
    )
    row = joins.latest_port_calls(calls).first()
    assert row["latest_delay_hours"] is None and row["latest_scheduled_arrival"].day == 21


def test_list_takes_ports_from_the_route(table):
    ports = table("ports", {"id": "p1", "port_name": "One"}, {"id": "p2", "port_name": "Two"}, {"id": "p3", "port_name": "Three"})
    routes = table("routes", {"id": "r1"})
    carriers = table("carriers", {"id": "ca1"})
    listed = projections.shipment_list(table("shipments", {"origin_port_id": "p3"}), carriers, routes, ports, AS_OF)
    row = listed.first()
    assert len(listed.columns) == 13
    assert row["origin_port"]["port_name"] == "One" and row["status_display"] == "In Transit" and row["carrier_mode"] == "Sea Freight"


def test_detail_has_a_row_per_shipment_and_pages_hold_cargo_whole(table):
    shipments, carriers = table("shipments", {}, {}), table("carriers", {"id": "ca1"})
    companies = table("companies", {"id": "co1", "legal_name": "A"}, {"id": "co2", "legal_name": "B"})
    cargo = table("cargo", *[{"id": f"g{n}"} for n in range(5)])
    events = table("tracking_events", {}, {"event_time": "2024-02-26"})
    detail = projections.shipment_detail(shipments, carriers, companies, cargo, events, AS_OF).orderBy("id").collect()
    assert [(r["id"], r["cargo_count"]) for r in detail] == [("s1", 5), ("s2", 0)]
    assert detail[0]["latest_event_time"].day == 26 and detail[1]["latest_event_time"] is None
    assert detail[0]["transit_duration_seconds"] == 7 * 86400
    pages = projections.cargo_pages(cargo, page_size=2).orderBy("cargo_page").collect()
    assert [(r["shipment_id"], r["cargo_page"], [i["id"] for i in r["cargo_items"]]) for r in pages] == [("s1", 0, ["g0", "g1"]), ("s1", 1, ["g2", "g3"]), ("s1", 2, ["g4"])]


def test_detail_shuffles_whole_shipments_three_times_at_most(spark, table):
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(name, value)
    try:
        companies = table("companies", {"id": "co1", "legal_name": "A"}, {"id": "co1", "legal_name": "A2"}, {"id": "co2", "legal_name": "B"})
        shipments = table("shipments", {"id": "s1"}, {"id": "s1"}, {"id": "none"}, {"shipper_id": None}).withColumn("id", F.expr("nullif(id, 'none')"))
        detail = projections.shipment_detail(shipments, table("carriers", {"id": "ca1"}), companies, table("cargo", {}, {}), table("tracking_events", {}), AS_OF)
        plan = spark._jvm.PythonSQLUtils.explainString(detail._jdf.queryExecution(), "formatted")
        wide = [part for part in plan.split("\n\n") if ") Exchange" in part and "hs_codes" in part]
        rows = sorted((r["id"] or "", r["shipper_name"], r["consignee_name"], r["cargo_count"]) for r in detail.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert 1 <= len(wide) <= 3
    assert rows == sorted((i, a, "B", n) for i, n in (("s1", 2), ("s1", 2), ("", 0)) for a in ("A", "A2"))


def test_only_shipments_with_more_than_a_page_are_numbered(table, monkeypatch):
    cargo = table("cargo", *[{"id": f"g{n}", "shipment_id": s} for n, s in enumerate(["s1", "s1", "s2", None, None, None, "s3", "s3", "s3", "s3", "s3"])])
    rows = lambda pages: sorted((r["shipment_id"] or "", r["cargo_page"], [i["id"] for i in r["cargo_items"]]) for r in pages.collect())
    whole = [("", 0, ["g3", "g4"]), ("", 1, ["g5"]), ("s1", 0, ["g0", "g1"]), ("s2", 0, ["g2"]), ("s3", 0, ["g10", "g6"]), ("s3", 1, ["g7", "g8"]), ("s3", 2, ["g9"])]
    numbered, positions = [], projections.positions
    monkeypatch.setattr(projections, "positions", lambda df, *a, **k: numbered.append(df.count()) or positions(df, *a, **k))
    assert rows(projections.cargo_pages(cargo, page_size=2)) == whole and numbered == [8]
    assert len(rows(projections.cargo_pages(cargo, page_size=5))) == 4 and numbered == [8]


def test_pages_shuffle_the_items_once(spark, table, monkeypatch, tmp_path):
    table("cargo", *[{"id": f"g{n}", "shipment_id": s} for n, s in enumerate(["s1", "s1", "s2", None, None, None, "s3", "s3", "s3"])]).write.parquet(str(tmp_path / "cargo"))
    cargo = spark.read.parquet(str(tmp_path / "cargo"))
    monkeypatch.setattr(projections, "materialized", None)  # nothing is stored
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(name, value)
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(projections.cargo_pages(cargo, page_size=2)._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shuffles = [part for part in plan.split("\n\n") if ") Exchange" in part]
    assert len(shuffles) == 1 and "gross_weight_kg" in shuffles[0] and ") ReusedExchange" in plan


def test_large_shipments_are_paged_by_ranges_to_the_same_pages(table, monkeypatch):
    owners = ["s1"] * 7 + [None] * 6 + ["s2"] * 3 + ["s3"] * 5 + ["s4"]
    cargo = table("cargo", *[{"id": f"g{n % 17:02d}", "shipment_id": s} for n, s in enumerate(owners)])
    rows = lambda: sorted((r["shipment_id"] or "", r["cargo_page"], [i["id"] for i in r["cargo_items"]]) for r in projections.cargo_pages(cargo, page_size=2).collect())
    whole, by_range, positions = rows(), [], projections.positions
    monkeypatch.setattr(projections, "MOST_IN_A_TASK", 5)
    monkeypatch.setattr(projections, "positions", lambda df, *a, whole=False, **k: by_range.append((df.count(), whole)) or positions(df, *a, whole=whole, **k))
    assert rows() == whole and by_range == [(13, False), (8, True)]
    assert sum(len(ids) for _, _, ids in whole) == len(owners) and whole[-1] == ("s4", 0, ["g04"])


def test_page_size_is_refused_outside_its_limits(table):
    for size in (0, 201):
        with pytest.raises(ValueError, match="size"):
            paging.page(table("shipments", {}), size=size)


def test_pages_cover_every_row_once(table):
    rows = [{"id": f"s{n:02d}", "departure_date": None if n < 4 else f"2024-02-{10 + n % 3} 00:00:00"} for n in range(20)]
    df = table("shipments", *rows)
    seen, cursor = [], None
    while True:
        got = paging.page(df.select("id", "departure_date"), cursor, size=3).collect()
        if not got:
            break
        seen += [r["id"] for r in got]
        cursor = paging.Cursor(got[-1]["departure_date"] and str(got[-1]["departure_date"]), got[-1]["id"])
    assert len(seen) == len(set(seen)) == 20 and seen[:4] == ["s00", "s01", "s02", "s03"]


def test_tracking_number_shape(spark):
    row = spark.range(1).select(C.tracking_number("id").alias("t"), C.tracking_number("id").alias("u")).first()
    assert row["t"] == row["u"] and row["t"].startswith("GT-") and len(row["t"]) == 11


def test_unknown_code_labels_itself(spark):
    df = spark.createDataFrame([("ODD",), (None,)], "code string")
    assert [r["l"] for r in df.select(C.label("code", {"A": "b"}).alias("l")).collect()] == ["ODD", None]


def test_ratio_rounds_half_up(spark):
    df = spark.createDataFrame([(Decimal("1.00"), 8), (Decimal("-1.00"), 8), (Decimal("5.00"), 0)], "a decimal(18,2), b bigint")
    got = [r["r"] for r in df.select(C.ratio(F.col("a"), F.col("b"), 2).alias("r")).collect()]
    assert got == [Decimal("0.13"), Decimal("-0.13"), None]


CARGO_FAULTS = [
    ({"gross_weight_kg": Decimal("0"), "net_weight_kg": None}, {"gross_weight_positive"}),
    ({"net_weight_kg": Decimal("1001")}, {"net_weight_lte_gross"}),
    ({"volume_cbm": Decimal("0")}, {"volume_positive"}),
    ({"is_hazmat": True}, {"hazmat_requires_un_number"}),
    ({"un_number": "12a4"}, {"un_number_format"}),
    ({"temperature_min_c": Decimal("2"), "temperature_max_c": Decimal("1")}, {"temperature_range_ordered"}),
    ({"package_count": 0}, {"package_count_positive"}),
    ({"net_weight_kg": None, "volume_cbm": None}, set()),
]


def test_cargo_row_rules(table):
    cargo = table("cargo", *[{"id": str(n), **fault} for n, (fault, _) in enumerate(CARGO_FAULTS)])
    found: dict[str, set] = {}
    for row in quality.row_violations(cargo, "cargo").collect():
        found.setdefault(row["key"], set()).add(row["rule_name"])
    assert found == {str(n): rules for n, (_, rules) in enumerate(CARGO_FAULTS) if rules}


def test_shipment_row_rules(table):
    faults = [
        ({"status": "LOST"}, "status_valid"),
        ({"declared_value": Decimal("-1")}, "declared_value_non_negative"),
        ({"estimated_arrival": "2024-02-23 12:00:00"}, "arrival_after_departure"),
        ({"actual_arrival": "2024-02-23 11:00:00"}, "actual_arrival_after_departure"),
        ({"currency_code": "usd"}, "currency_code_iso4217"),
    ]
    df = table("shipments", *[f for f, _ in faults], {"departure_date": None, "declared_value": None})
    assert [(r["key"], r["rule_name"]) for r in quality.row_violations(df, "shipments").orderBy("key").collect()] == [(f"s{n}", rule) for n, (_, rule) in enumerate(faults, 1)]


def test_every_table_has_working_rules(table):
    for name in ("companies", "ports", "carriers", "routes", "shipments", "cargo", "tracking_events", "port_calls", "analytics_snapshots"):
        good = {"analytics_snapshots": {"entity_type": "GLOBAL", "granularity": "DAILY"}}.get(name, {})
        assert quality.row_violations(table(name, good), name).count() == 0, name


def test_unique_rules(table):
    lanes = table("routes", {}, {}, {"status": "SUSPENDED"}, {"route_code": "R1", "origin_port_id": "p9"})
    assert {(r["key"], r["rule_name"]) for r in quality.unique_violations(lanes, "routes").collect()} == {("ca1|p1|p2", "active_lane_unique"), ("R1", "route_code_unique")}
    ships = table("shipments", {"bill_of_lading": ""}, {"bill_of_lading": ""}, {"bill_of_lading": "X"}, {"bill_of_lading": "X"})
    assert [r["key"] for r in quality.unique_violations(ships, "shipments").collect()] == ["X"]
    snaps = table("analytics_snapshots", *[{"entity_type": "GLOBAL", "metric_key": "m", "snapshot_date": "2024-01-01", "granularity": "DAILY"}] * 2)
    assert quality.unique_violations(snaps, "analytics_snapshots").count() == 1


def test_references_allow_null(table):
    stored = {"shipments": table("shipments", {}), "ports": table("ports", {"id": "p1"}), "tracking_events": table("tracking_events", {"port_id": None}, {"shipment_id": "gone", "port_id": "p1"})}
    assert [(r["key"], r["rule_name"]) for r in quality.reference_violations(stored, "tracking_events").collect()] == [("t2", "shipment_id_exists")]


def test_illegal_moves(spark):
    log = [("s", 1, "DRAFT"), ("s", 2, "BOOKED"), ("s", 3, "BOOKED"), ("s", 4, "DELIVERED"), ("s", 5, "IN_TRANSIT"), ("t", 1, "IN_TRANSIT"), ("t", 2, "CUSTOMS_HOLD")]
    df = spark.createDataFrame([(f"{s}{n}", s, n, st) for s, n, st in log], "id string, shipment_id string, n int, status string")
    df = df.select("id", "shipment_id", F.timestamp_seconds("n").alias("changed_at"), "status")
    bad = {(r["id"], r["from_status"], r["to_status"], r["terminal"]) for r in quality.illegal_moves(df).collect()}
    assert bad == {("s4", "BOOKED", "DELIVERED", False), ("s5", "DELIVERED", "IN_TRANSIT", True), ("t2", "IN_TRANSIT", "CUSTOMS_HOLD", False)}


def test_cargo_submissions(table):
    df = table("cargo", {}, {"cargo_type": "REEFER"}, {"is_hazmat": True}, {"is_hazmat": True, "un_number": "1263"}, {"un_number": "12"}, {"net_weight_kg": Decimal("2000"), "is_hazmat": True})
    got = [r["error"] for r in quality.check_cargo(df).orderBy("id").collect()]
    assert got == [None, "reefer_without_temperature", "hazmat_without_un_number", None, "un_number_not_4_digits", "net_weight_above_gross"]


def test_event_submissions(table):
    shipments = table("shipments", {}, {"status": "DELIVERED"}, {"status": "BOOKED"})
    given = [
        {"exception_description": "", "description": "x"},
        {"shipment_id": "s2"},
        {"shipment_id": "s3"},
        {"event_time": "2024-03-02"},
        {"is_exception": True, "event_type": "EXCEPTION"},
        {"is_exception": True, "event_type": "EXCEPTION", "exception_description": "bad", "description": "more"},
        {"is_exception": True, "event_type": "EXCEPTION", "exception_description": "bad"},
        {"shipment_id": "none"},
    ]
    events = table("tracking_events", *[{k: v for k, v in g.items() if k != "exception_description"} for g in given])
    texts = F.element_at(F.array(*[F.lit(g.get("exception_description", "")) for g in given]), F.substring("id", 2, 1).cast("int"))
    got = quality.check_events(events.withColumn("exception_description", texts), shipments, C.instant(AS_OF)).orderBy("id").collect()
    assert [r["error"] for r in got] == [None, "shipment_closed", "event_type_not_allowed", "event_in_future", "exception_without_description", None, None, "shipment_missing"]
    assert [r["description"] for r in got][5:7] == ["[EXCEPTION] bad\nmore", "[EXCEPTION] bad"]
