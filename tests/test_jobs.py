from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from freight import AS_OF
from pyspark.sql import functions as F

from lanewise.functions import columns as C
from lanewise.functions import domain
from lanewise.plans import jobs, matviews
from lanewise.plans.refresh import Freight, populate_snapshots, refresh_carrier_days, refresh_periods, refresh_views, view_table
from lanewise.sources import generator, tables
from lanewise.sources.snapshot_store import SnapshotStore
from lanewise.sources.folders import subfolders
from lanewise.sources.periods import PeriodTable
from lanewise.sources.versions import DuplicateKeyError, VersionedTable

def now():
    return C.instant(AS_OF)



@pytest.fixture(scope="module")
def freight(table):
    return Freight(
        shipments=table("shipments", {"departure_date": "2024-02-29 01:00:00"}, {"departure_date": "2024-02-28"}),
        cargo=table("cargo", {}),
        tracking_events=table("tracking_events", {"port_id": "p1"}),
        port_calls=table("port_calls", {}),
        carriers=table("carriers", {"id": "ca1"}),
        routes=table("routes", {"id": "r1"}),
    )


def test_delay_notices_once_a_day(table):
    overdue = {"estimated_arrival": "2024-03-01 06:30:00"}
    shipments = table("shipments", overdue, {**overdue, "status": "DELIVERED"}, {**overdue, "actual_arrival": "2024-03-01 08:00:00"}, {"estimated_arrival": "2024-03-01 10:30:00"}, {**overdue, "status": "EXCEPTION"})
    log = table("tracking_events", {"event_type": "DELAY", "event_time": "2024-02-29 23:59:59"})
    new = jobs.delay_notifications(shipments, log, AS_OF, 2)
    (row,) = new.collect()
    assert row["description"] == "Shipment is 5h past estimated arrival. ETA was 2024-03-01 06:30 UTC."
    assert '"eta":"2024-03-01T06:30:00+00:00"' in row["raw_payload"] and not row["is_exception"]
    assert tuple(jobs.delay_counts(shipments, log, AS_OF).first()) == (1, 0)
    told = log.unionByName(new, allowMissingColumns=True)
    assert jobs.delay_notifications(shipments, told, AS_OF, 2).count() == 0
    assert tuple(jobs.delay_counts(shipments, told, AS_OF).first()) == (0, 1)


def messages(spark, *rows):
    full = [("w", "C1", "GATE_OUT", "S1", "2024-03-01 11:00:00", {"k": "v"}, "2024-03-01 11:30:00", 0)]
    names = ["webhook_id", "carrier_code", "event_type", "shipment_reference", "event_timestamp", "payload", "received_at", "retries"]
    data = [tuple({**dict(zip(names, full[0])), **r}.values()) for r in rows]
    df = spark.createDataFrame(data, "webhook_id string, carrier_code string, event_type string, shipment_reference string, t string, payload map<string,string>, r string, retries int")
    return df.select(*names[:4], F.to_timestamp("t").alias("event_timestamp"), "payload", F.to_timestamp("r").alias("received_at"), "retries")


def test_message_outcomes(spark, table):
    shipments = table("shipments", {}, {"carrier_id": "ca2"})
    carriers = table("carriers", {"id": "ca1", "carrier_code": "C1"}, {"id": "ca2", "carrier_code": "C2", "is_active": False})
    log = table("tracking_events", {"raw_payload": '{"webhook_id":"seen"}'})
    batch = messages(
        spark,
        {"webhook_id": "ok"},
        {"webhook_id": "ok", "received_at": "2024-03-01 11:40:00", "event_type": "SECOND"},
        {"webhook_id": "seen"},
        {"webhook_id": "who", "carrier_code": "XX"},
        {"webhook_id": "off", "carrier_code": "C2", "shipment_reference": "S2"},
        {"webhook_id": "other", "shipment_reference": "S2"},
        {"webhook_id": "23h", "shipment_reference": "S9", "received_at": "2024-02-29 13:00:00", "retries": 2},
        {"webhook_id": "25h", "shipment_reference": "S9", "received_at": "2024-02-29 11:00:00"},
        {"webhook_id": "late", "retries": 3},
    )
    matched = jobs.match_messages(batch, jobs.processed_webhooks(log), carriers, shipments, now())
    status = {r["webhook_id"]: r["status"] for r in matched.collect()}
    assert status == {"ok": "matched", "seen": "already_processed", "who": "carrier_not_found", "off": "carrier_not_found", "other": "retry", "23h": "retry", "25h": "expired", "late": "matched"}
    rows = {r["description"]: r for r in jobs.message_events(matched, now()).collect()}
    assert set(rows) == {"Carrier webhook: GATE_OUT", "Carrier webhook (delayed match): GATE_OUT"}
    assert rows["Carrier webhook: GATE_OUT"]["event_time"] == datetime(2024, 3, 1, 11)
    assert rows["Carrier webhook: GATE_OUT"]["source_system"] == "WEBHOOK:C1"
    assert '"webhook_id":"ok"' in rows["Carrier webhook: GATE_OUT"]["raw_payload"] and "matched_at" not in rows["Carrier webhook: GATE_OUT"]["raw_payload"]
    waiting = {r["webhook_id"]: r for r in jobs.still_waiting(matched, now()).collect()}
    assert waiting["23h"]["next_try_at"] == datetime(2024, 3, 1, 12, 2) and waiting["23h"]["retries"] == 3


def replay(changes: list[tuple], current: dict) -> dict:
    """The status machine, one request at a time."""
    state, out = dict(current), {}
    for ident, ship, _, asked in sorted(changes, key=lambda c: (c[1], c[2], c[0])):
        old = state.get(ship)
        if old is None:
            out[ident] = (None, "shipment_missing")
        elif asked == old:
            out[ident] = (old, "unchanged")
        elif asked in domain.STATUS_MOVES[old]:
            out[ident] = (old, "applied")
            state[ship] = asked
        else:
            out[ident] = (old, "rejected")
    return out


@pytest.mark.parametrize("block", [2, 256])
def test_changes_replay_in_order(spark, table, block):
    rng = random.Random(block)
    live = [s for s in domain.SHIPMENT_STATUSES if s not in domain.TERMINAL_STATUSES]
    current = {f"s{n}": rng.choice(live) for n in range(5)}
    asked = [*live, *live, "DELIVERED", "LOST"]
    changes = [(f"x{n:03d}", "s0" if rng.random() < 0.5 else f"s{rng.randrange(7)}", datetime(2024, 1, 1) + timedelta(hours=rng.randrange(60)), rng.choice(asked)) for n in range(80)]
    log = spark.createDataFrame([(*c, None, "") for c in changes], "id string, shipment_id string, changed_at timestamp, new_status string, note string, event_location string")
    shipments = table("shipments", *[{"id": s, "status": st} for s, st in current.items()])
    got = {r["id"]: (r["old_status"], r["outcome"]) for r in jobs.resolve_changes(log, shipments, block).collect()}
    assert got == replay(changes, current)


def test_delivery_sets_arrival_and_events(spark, table):
    rows = [("1", "s1", "2024-03-01 01:00:00", "AT_PORT", "", ""), ("2", "s1", "2024-03-01 02:00:00", "DELIVERED", "signed", "Gate 4"), ("3", "s1", "2024-03-01 03:00:00", "IN_TRANSIT", None, None)]
    log = spark.createDataFrame(rows, "id string, shipment_id string, t string, new_status string, note string, event_location string")
    log = log.select("id", "shipment_id", F.to_timestamp("t").alias("changed_at"), "new_status", "note", "event_location")
    shipments = table("shipments", {}, {"id": "s2"})
    resolved = jobs.resolve_changes(log, shipments)
    after = {r["id"]: r for r in jobs.apply_changes(shipments, resolved).collect()}
    assert after["s1"]["status"] == "DELIVERED" and after["s1"]["actual_arrival"].hour == 2 and after["s2"]["status"] == "IN_TRANSIT"
    events = {r["event_type"]: r for r in jobs.change_events(resolved).collect()}
    assert events["ARRIVAL"]["description"] == "Status changed from IN_TRANSIT to AT_PORT."
    assert events["DELIVERED"]["description"] == "signed" and events["DELIVERED"]["location_description"] == "Gate 4"


def test_bookings(spark, table):
    base = ("k1", "co1", "co2", None, "ca1", "r1", "p1", "p2", "2024-03-11 12:00:00", None, Decimal("50000.00"), None, "eur")
    names = "idempotency_key shipper_id consignee_id notify_party_id carrier_id route_id origin_port_id destination_port_id d e declared_value freight_cost currency_code".split()
    faults = [
        ({}, None),
        ({}, None),
        ({"idempotency_key": "used"}, None),
        ({"d": "2024-03-01 12:00:00", "carrier_id": "none"}, "departure_in_past"),
        ({"currency_code": "EU1"}, "currency_not_3_letters"),
        ({"carrier_id": "none"}, "carrier_missing"),
        ({"carrier_id": "off"}, "carrier_inactive"),
        ({"route_id": "none"}, "route_missing"),
        ({"route_id": "r2"}, "route_of_other_carrier"),
        ({"route_id": "r3"}, "route_not_bookable"),
        ({"origin_port_id": "p9"}, "origin_not_on_route"),
        ({"destination_port_id": "p9"}, "destination_not_on_route"),
        ({"e": "2024-03-11 12:00:00"}, "arrival_not_after_departure"),
    ]
    rows = [tuple({**dict(zip(names, base)), **({"idempotency_key": f"k{n}"} if n > 1 else {}), **f}.values()) for n, (f, _) in enumerate(faults)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'decimal(18,2)' if n in ('declared_value', 'freight_cost') else 'string'}" for n in names))
    df = df.withColumns({"departure_date": F.to_timestamp("d"), "estimated_arrival": F.to_timestamp("e")}).drop("d", "e")
    carriers = table("carriers", {"id": "ca1"}, {"id": "off", "is_active": False})
    routes = table("routes", {"id": "r1"}, {"id": "r2", "carrier_id": "off"}, {"id": "r3", "status": "SUSPENDED"})
    stored = table("shipments", {"custom_attributes": '{"idempotency_key":"used"}'})
    from lanewise.operators.quality import check_bookings

    errors = sorted((r["idempotency_key"], r["error"]) for r in check_bookings(df, carriers, routes, now()).collect() if r["error"])
    assert errors == sorted((f.get("idempotency_key", f"k{n}"), e) for n, (f, e) in enumerate(faults) if e)
    accepted = jobs.accept_bookings(df, stored, carriers, routes, now())
    (row,) = accepted.collect()
    assert (row["status"], row["currency_code"], row["custom_attributes"]) == ("DRAFT", "EUR", '{"idempotency_key":"k1"}')
    assert jobs.accept_bookings(df, stored.unionByName(accepted, allowMissingColumns=True), carriers, routes, now()).count() == 0
    (event,) = jobs.booking_events(accepted).collect()
    assert event["event_type"] == "DOC_RECEIVED" and event["shipment_id"] == row["id"]


def test_refresh_by_name_and_all(spark, freight, tmp_path):
    root = str(tmp_path)
    assert refresh_views(spark, root, freight, AS_OF, "mv_port_congestion")["rows"] == {"mv_port_congestion": 1}
    done = refresh_views(spark, root, freight, AS_OF)
    assert len(done["refreshed"]) == 3 and done["rows"]["mv_carrier_daily_stats"] == 2
    assert view_table(spark, root, "mv_port_congestion").current() == 2
    with pytest.raises(ValueError):
        refresh_views(spark, root, freight, AS_OF, "mv_nothing")


def test_touched_days_only(spark, table, freight, tmp_path):
    root = str(tmp_path)
    refresh_views(spark, root, freight, AS_OF, "mv_carrier_daily_stats")
    # the second shipment moves to another day and a third one is new
    more = table("shipments", {"departure_date": "2024-02-29 01:00:00"}, {"departure_date": "2024-02-27"}, {"departure_date": "2024-02-27 05:00:00"})
    touched = spark.sql("select 'ca1' as carrier_id, explode(array(date'2024-02-27', date'2024-02-28')) as stat_date")
    later = Freight(more, freight.cargo, freight.tracking_events, freight.port_calls, freight.carriers, freight.routes)
    refresh_carrier_days(spark, root, later, AS_OF, touched)
    part = view_table(spark, root, "mv_carrier_daily_stats").read().orderBy("stat_date").collect()
    whole = matviews.carrier_daily_stats(more, freight.cargo, freight.tracking_events, AS_OF).orderBy("stat_date").collect()
    assert part == whole
    # only the touched month was written again, and what no list names is gone after the next one
    table_ = view_table(spark, root, "mv_carrier_daily_stats")
    assert subfolders(spark, f"{root}/mv_carrier_daily_stats/w-00000002") == ["period=2024-02-01"]
    for _ in range(2):
        table_.publish(matviews.carrier_daily_stats(more, freight.cargo, freight.tracking_events, AS_OF))
    assert [n for n in subfolders(spark, f"{root}/mv_carrier_daily_stats") if n.startswith("w-")] == ["w-00000003", "w-00000004"]


def test_periods_are_replaced_one_by_one(spark, tmp_path):
    made = lambda *rows: spark.createDataFrame(rows, "k int, day string, v int").withColumn("day", F.to_date("day"))
    store = PeriodTable(spark, str(tmp_path / "p"), ["k"], "day")
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.publish(made((1, "2024-01-31", 1), (2, "2024-02-01", 1), (3, "2024-03-05", 1)))["rows"] == 3
    with pytest.raises(ValueError, match="outside"):
        store.publish(made((4, "2024-03-05", 1)), ["2024-02-01"])
    with pytest.raises(DuplicateKeyError):
        store.publish(made((2, "2024-02-01", 1), (2, "2024-02-02", 1)), ["2024-02-01"])
    before = store.read()
    store.publish(made((2, "2024-02-20", 7)), ["2024-02-01", "2024-03-01"])
    rows = lambda df: sorted((r["k"], str(r["day"]), r["v"]) for r in df.collect())
    assert rows(store.read()) == [(1, "2024-01-31", 1), (2, "2024-02-20", 7)] and len(rows(before)) == 3
    assert rows(store.read(since="2024-02-01")) == [(2, "2024-02-20", 7)] and rows(store.read(until="2023-12-01")) == []
    store.publish(made().limit(0))
    assert store.read().count() == 0 and store.read().columns == ["k", "day", "v"]


def test_refreshed_periods_equal_the_whole_view(spark, table, freight, tmp_path):
    root = str(tmp_path)
    calls = table("port_calls", {"port_id": "p1", "scheduled_arrival": "2024-02-12 00:00:00"}, {"port_id": "p1", "scheduled_arrival": "2024-02-19 01:00:00"}, {"port_id": "p1", "scheduled_arrival": "2024-02-26 00:00:00"})
    events = table("tracking_events", *[{"port_id": "p1", "event_time": t, "is_exception": True} for t in ("2024-02-11 12:00:00", "2024-02-17 01:00:00", "2024-02-21 01:00:00", "2024-02-25 00:00:00")])
    tables_ = Freight(freight.shipments, freight.cargo, events, calls, freight.carriers, freight.routes)
    refresh_views(spark, root, Freight(freight.shipments, freight.cargo, events.filter("false"), calls, freight.carriers, freight.routes), AS_OF, "mv_port_congestion")
    refresh_periods(spark, root, tables_, AS_OF, "mv_port_congestion", ["2024-02-12", "2024-02-19", "2024-02-26"])
    whole = matviews.port_congestion(calls, events)
    assert sorted(map(str, view_table(spark, root, "mv_port_congestion").read().collect())) == sorted(map(str, whole.collect()))


def test_duplicate_keys_are_not_published(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"), ["k"])
    store.publish(spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(DuplicateKeyError):
        store.publish(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"))
    assert [tuple(r) for r in store.read().collect()] == [(1, "a")]
    assert store.publish(spark.createDataFrame([(2, "c")], "k int, v string"))["version"] == 3


def test_snapshots_twice_change_nothing(spark, freight, tmp_path):
    root = str(tmp_path)
    first = populate_snapshots(spark, root, freight, AS_OF)
    assert first == {"date": "2024-02-29", "entity_type": "ALL", "upserted": 8, "errors": [], "status": "ok"}
    before = SnapshotStore(spark, root).read("2024-02-29", "2024-02-01").collect()
    assert populate_snapshots(spark, root, freight, AS_OF)["upserted"] == 8
    after = SnapshotStore(spark, root).read("2024-02-29", "2024-02-01").collect()
    assert sorted(map(str, before)) == sorted(map(str, after)) and len(after) == 8


def test_one_failing_entity_type(spark, freight, tmp_path):
    broken = Freight(freight.shipments, freight.cargo, freight.tracking_events, freight.port_calls, spark.sql("select 'ca1' as id"), freight.routes)
    got = populate_snapshots(spark, str(tmp_path), broken, AS_OF, "2024-02-29")
    assert got["status"] == "partial" and got["upserted"] == 5 and got["errors"][0].startswith("CARRIER")
    with pytest.raises(RuntimeError):
        populate_snapshots(spark, str(tmp_path), broken, AS_OF, "2024-02-29", "CARRIER")
    with pytest.raises(ValueError):
        populate_snapshots(spark, str(tmp_path), broken, AS_OF, "2024-02-29", "PORT")


def test_append_and_get_or_create(spark, tmp_path):
    stored = spark.createDataFrame([(1, "old")], "k int, v string")
    path = str(tmp_path / "t")
    stored.write.parquet(path)
    rows = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (3, "c")], "k int, v string")
    tables.append_ignoring_conflicts(path, spark.read.parquet(path), rows, ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "old"), (2, "a"), (3, "c")]
    got = tables.get_or_create(stored, rows, ["k"], ["v"])
    assert sorted((r["k"], r["v"], r["created"]) for r in got.collect()) == [(1, "old", False), (2, "a", True), (3, "c", True)]


def test_read_table_checks_the_name(spark):
    with pytest.raises(ValueError):
        tables.read_table(spark, "/nowhere", "people")


def test_generated_data_is_repeatable_and_valid(spark):
    from lanewise.operators import quality

    slots = spark.range(500).withColumnRenamed("id", "n")
    made = generator.shipments(slots, AS_OF, seed=4)
    assert made.exceptAll(generator.shipments(slots.repartition(7), AS_OF, seed=4)).count() == 0
    shares = {r["status"]: r["count"] / 500 for r in made.groupBy("status").count().collect()}
    assert abs(shares["DELIVERED"] - 0.4) < 0.08 and abs(shares["IN_TRANSIT"] - 0.3) < 0.08
    lanes = generator.routes(spark, AS_OF, seed=4)
    assert lanes.count() == 20 and made.join(lanes, made.route_id == lanes.id, "left_anti").count() == 0
    cargo = generator.cargo(made, seed=4)
    assert 500 <= cargo.count() <= 1500 and made.join(cargo, made.id == cargo.shipment_id, "left_anti").count() == 0
    events = generator.tracking_events(made)
    for name, df in (("shipments", made), ("cargo", cargo), ("tracking_events", events)):
        assert quality.row_violations(df, name).count() == 0
    assert generator.ports(spark).count() == 10 and generator.companies(spark).count() == 8 and generator.carriers(spark).count() == 5


def test_periods_read_by_days(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"1996-0{1 + k // 28}-{1 + k % 28:02d}") for k in range(80)], "id int, day string").select("id", F.to_date("day").alias("day"))
    for unit in ("month", "week"):
        kept = PeriodTable(spark, str(tmp_path / unit), ["id"], "day", unit)
        assert kept.publish(rows)["rows"] == 80
        for since, until in (("1996-01-15", None), ("1996-01-20", "1996-02-03"), (None, "1996-01-31"), ("1996-02-29", "1996-03-01")):
            want = {r["id"] for r in rows.collect() if (since is None or str(r["day"]) >= since) and (until is None or str(r["day"]) <= until)}
            assert {r["id"] for r in kept.read(since, until).collect()} == want
