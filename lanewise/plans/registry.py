"""Named queries over the given tables; each takes (spark, directory) and returns a DataFrame.

Outputs are flat: decimals as doubles, instants as zone-less UTC timestamps, nested values as text, so
that any engine can compare them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.functions import columns as C
from lanewise.functions import domain
from lanewise.functions.signatures import pads, signature
from lanewise.operators import chains, containment, derive, filters, intervals, joins, names, paging, projections, quality, windows
from lanewise.operators.filters import Principal, ShipmentCriteria
from lanewise.operators.ordering import union_all
from lanewise.plans import jobs, matviews, reports, sketches, snapshots
from lanewise.plans.refresh import Freight, populate_snapshots, refresh_periods, refresh_views, view_table
from lanewise.sources import generator, tables
from lanewise.sources.bindings import Bindings
from lanewise.sources.checkpoints import materialized, run_folder, shuffle_files_deleted
from lanewise.sources.periods import PeriodTable
from lanewise.sources.snapshot_store import SnapshotStore
from lanewise.sources.versions import replaced
from lanewise.streaming import ingest, keyed_ingest, monitors

AS_OF = "1998-06-01 00:00:00"  # both late and timely open shipments
AS_OF_LAST = "2001-08-01 00:00:00"  # end of the order history
AS_OF_EVENTS = "2024-01-31 00:00:00"  # end of the event stream
DAY = "1998-05-20"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def flat(df: DataFrame) -> DataFrame:
    """Types every engine shares."""

    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(fn: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
    _QUERIES[fn.__name__] = lambda spark, directory: flat(fn(Bindings(spark, directory)))
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


# scans and writes


def _scan(name: str) -> None:
    _QUERIES[f"a1_scan_{name}"] = lambda spark, directory: flat(getattr(Bindings(spark, directory), name))


for _name in ("companies", "ports", "carriers", "routes", "shipments", "cargo", "tracking_events", "port_calls"):
    _scan(_name)


@query
def a2_port_calls_default_order(b):
    return tables.in_default_order(b.port_calls.select("id", "route_id", "call_sequence", "port_id"), "port_calls")


def _resent(b: Bindings) -> DataFrame:
    """Events sent again: half are stored already, the rest are new and come twice."""
    stored = b.tracking_events.select("id", "shipment_id", "event_type", "event_time")
    again = stored.filter(F.pmod("id", F.lit(2)) == 0)
    new = stored.filter(F.pmod("id", F.lit(2)) == 1).withColumn("id", F.col("id") + 1_000_000_000_000)
    return union_all([again, new, new.withColumn("shipment_id", F.col("shipment_id") + 1)])


@query
def a3_append_ignoring_conflicts(b):
    stored = b.tracking_events.select("id", "shipment_id", "event_type", "event_time")
    return tables.new_rows(stored, _resent(b), ["id"], ["shipment_id"])


@query
def a3_append_under_all_keys(b):
    """Bookings of which each shares its number with one and its bill of lading with another: who comes first is stored."""
    rows = b.shipments.select("id", F.floor(F.col("id") / 3).alias("number"), F.floor((F.col("id") + 1) / 3).alias("bill"), F.when(F.pmod("id", F.lit(5)) > 0, F.col("carrier_id")).alias("carrier_id"), F.to_date("departure_date").alias("day"))
    stored = rows.filter(F.pmod("id", F.lit(7)) == 0)
    return tables.new_rows_under(stored, rows.filter(F.pmod("id", F.lit(7)) != 0), [["number"], ["bill"], ["carrier_id", "day"]], ["day", "id"]).select("id")


@query
def a4_get_or_create_ports(b):
    wanted = b.ports.select(F.concat(F.substring("un_locode", 1, 4), F.pmod("id", F.lit(3)).cast("string")).alias("un_locode"), "port_name", F.col("id").alias("rank"))
    stored = b.ports.select("un_locode", "port_name", F.col("id").alias("rank"))
    return tables.get_or_create(stored, wanted, ["un_locode"], ["rank"])


@query
def a5_delete_tagged(b):
    return tables.without(b.shipments, F.array_contains("tags", "seed")).select("id", "status", "tracking_number")


@query
def a6_generated_shipments(b):
    slots = b.raw("orders").select(F.col("o_orderkey").alias("n"))
    return generator.shipments(slots, AS_OF).drop("hs_codes", "tags")


@query
def a6_generated_cargo(b):
    slots = b.raw("orders").select(F.col("o_orderkey").alias("n"))
    return generator.cargo(generator.shipments(slots, AS_OF))


@query
def a6_generated_events(b):
    slots = b.raw("orders").select(F.col("o_orderkey").alias("n"))
    return generator.tracking_events(generator.shipments(slots, AS_OF))


@query
def a7_upserted_snapshots(b):
    before = snapshots.global_snapshots(b.shipments, DAY, "1998-06-30 00:00:00")
    other = snapshots.carrier_snapshots(b.shipments, b.carriers, DAY, "1998-06-30 00:00:00")
    fresh = snapshots.global_snapshots(b.shipments, DAY, AS_OF)
    return replaced(before.unionByName(other), fresh, snapshots.KEY).drop("id")


def _published(b: Bindings, view: str) -> PeriodTable:
    """The view published whole in a run folder, after a first version that lacks part of the rows."""
    root = run_folder(b.shipments.sparkSession)
    whole = Freight(b.shipments, b.cargo, b.tracking_events, b.port_calls, b.carriers, b.routes)
    early = replace(whole, shipments=b.shipments.filter(F.pmod("id", F.lit(3)) > 0), port_calls=b.port_calls.filter(F.pmod("id", F.lit(3)) > 0))
    spark = b.shipments.sparkSession
    refresh_views(spark, root, early, AS_OF, view)
    refresh_views(spark, root, whole, AS_OF, view)
    return view_table(spark, root, view)


def _snapshot_rows(b: Bindings) -> DataFrame:
    """The snapshots of a day as the job writes them, read back as the stored table."""
    spark, root = b.shipments.sparkSession, run_folder(b.shipments.sparkSession)
    whole = Freight(b.shipments, b.cargo, b.tracking_events, b.port_calls, b.carriers, b.routes)
    for entity in ("CARRIER", "GLOBAL"):
        populate_snapshots(spark, root, whole, AS_OF, DAY, entity)
    SnapshotStore(spark, root).read(DAY).write.parquet(f"{root}/all/analytics_snapshots")
    return tables.read_table(spark, f"{root}/all", "analytics_snapshots")


@query
def a1_scan_analytics_snapshots(b):
    """Also the snapshot job run: both entity types of one date through the store."""
    return _snapshot_rows(b).select("entity_type", "entity_id", "snapshot_date", "granularity", "metric_key", "metric_value", "dimensions")


@query
def e1_e3_snapshot_violations(b):
    """Snapshots with a wrong granularity for one metric and a second row for another."""
    rows = _snapshot_rows(b)
    hourly = F.when(F.col("metric_key") == "shipments.delay_count", F.lit("HOURLY")).otherwise(F.col("granularity"))
    twice = rows.withColumn("granularity", hourly).unionByName(rows.filter("metric_key = 'shipments.count'"))
    broken = quality.row_violations(twice, "analytics_snapshots").groupBy("table", "rule_name").agg(F.count("*").alias("n"))
    return broken.unionByName(quality.unique_violations(twice, "analytics_snapshots").groupBy("table", "rule_name").agg(F.count("*").alias("n")))


@query
def a8_view_keys_unique(b):
    daily = _published(b, "mv_carrier_daily_stats").read()
    return daily.groupBy("carrier_id", "stat_date").agg(F.count("*").alias("rows")).agg(F.sum("rows").alias("rows"), F.max("rows").alias("most"))


@query
def a8_refreshed_months(b):
    """A view built from part of the shipments, then refreshed for the months of 1996 and 1997 only."""
    spark = b.shipments.sparkSession
    root = run_folder(spark)
    whole = Freight(b.shipments, b.cargo, b.tracking_events, b.port_calls, b.carriers, b.routes)
    early = replace(whole, shipments=b.shipments.filter(F.pmod("id", F.lit(3)) > 0))
    refresh_views(spark, root, early, AS_OF, "mv_route_monthly_performance")
    refresh_periods(spark, root, whole, AS_OF, "mv_route_monthly_performance", [f"{y}-{m:02d}-01" for y in (1996, 1997) for m in range(1, 13)])
    return view_table(spark, root, "mv_route_monthly_performance").read().select("route_id", "stat_month", "shipment_count", "total_declared_value")


# projections


def _list_columns(listed: DataFrame) -> DataFrame:
    for side in ("origin", "destination"):
        listed = listed.withColumns({f"{side}_locode": F.col(f"{side}_port.un_locode"), f"{side}_name": F.col(f"{side}_port.port_name")})
    return listed.drop("origin_port", "destination_port")


@query
def b1_shipment_list(b):
    return _list_columns(projections.shipment_list(b.shipments, b.carriers, b.routes, b.ports, AS_OF))


@query
def b2_shipment_detail(b):
    return projections.shipment_detail(b.shipments, b.carriers, b.companies, b.cargo, b.tracking_events, AS_OF)


@query
def b2_detail_cargo(b):
    """Every nested field of the detail's cargo, a row an item."""
    pages = projections.cargo_pages(b.cargo)
    return pages.select("shipment_id", "cargo_page", F.explode("cargo_items").alias("item")).select("shipment_id", "cargo_page", "item.*")


@query
def b3_cargo_view(b):
    return projections.cargo_view(b.cargo)


@query
def b4_event_timeline(b):
    return projections.event_timeline(b.tracking_events, b.ports)


@query
def b5_status_labels(b):
    labelled = b.shipments.groupBy("status").agg(F.count("*").alias("n"))
    return labelled.select("status", C.label("status", domain.SHIPMENT_STATUSES).alias("label"), "n")


@query
def b6_report_types(b):
    return projections.leaderboard_view(reports.carrier_leaderboard(b.shipments, b.cargo, b.carriers, AS_OF))


# filters


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id", "status", "declared_value")


@query
def c1_active(b):
    return _ids(filters.active(b.shipments))


@query
def c2_delayed(b):
    return _ids(filters.delayed(b.shipments, AS_OF))


@query
def c3_high_value(b):
    return _ids(filters.high_value(b.shipments, Decimal("250000.00")))


@query
def c4_by_carrier(b):
    return _ids(filters.by_carrier(b.shipments, 7))


@query
def c5_in_date_range(b):
    return _ids(filters.in_date_range(b.shipments, "1997-01-01", "1997-03-31"))


@query
def c6_for_shipment(b):
    return filters.for_shipment(b.tracking_events, 40).select("id", "event_type", "event_time")


@query
def c7_unresolved_exceptions(b):
    return filters.unresolved_exceptions(b.tracking_events).select("id", "shipment_id")


@query
def c8_events_in_time_range(b):
    return filters.in_time_range(b.tracking_events, "2024-01-05 06:00:00", "2024-01-09 18:00:00").select("id", "event_time")


@query
def c9_active_carriers_by_mode(b):
    return filters.by_mode(filters.active_carriers(b.carriers), "AIR").select("id", "carrier_name")


@query
def c10_hubbing_through(b):
    return filters.hubbing_through(b.carriers, "AAN00").select("id", "carrier_code")


@query
def c10_hubbing_through_both(b):
    return filters.hubbing_through(b.carriers, "AAN00", "APN15").select("id", "carrier_code")


@query
def c11_ports(b):
    sea = filters.by_type(filters.active_ports(b.ports), "SEA").select("id", F.lit("active sea").alias("test"))
    country = filters.by_country(b.ports, "BB").select("id", F.lit("country").alias("test"))
    code = filters.lookup_by_locode(b.ports, "AAN00").select("id", F.lit("locode").alias("test"))
    return union_all([sea, country, code])


@query
def c12_tagged(b):
    return _ids(filters.tagged(b.shipments, "seed"))


@query
def c13_json_key(b):
    found = filters.json_equals(b.shipments, "custom_attributes", "idempotency_key", "key-0000000123").select(F.col("id"), F.lit("equals").alias("test"))
    return found.unionByName(filters.json_has(b.tracking_events, "raw_payload", "webhook_id").select("id", F.lit("has").alias("test")))


@query
def c14_list_filters(b):
    criteria = ShipmentCriteria(
        statuses=("IN_TRANSIT", "AT_PORT"),
        departure_after="1997-01-01",
        departure_before="1998-12-31",
        min_value=Decimal("50000"),
        max_value=Decimal("400000"),
        is_delayed=True,
    )
    return _ids(filters.matching(b.shipments, criteria, AS_OF))


@query
def c14_list_filters_carrier(b):
    return _ids(filters.matching(b.shipments, ShipmentCriteria(carrier_id=3, is_delayed=False), AS_OF, b.carriers))


@query
def c15_last_90_days(b):
    return _ids(filters.departed_since(b.shipments, AS_OF_LAST, 90))


@query
def c16_company_scope(b):
    return _ids(filters.visible_to_company(b.shipments, Principal(company_id=30)))


@query
def c17_carrier_scope(b):
    return _ids(filters.visible_to_carrier(b.shipments, Principal(carrier_id=5)))


@query
def c18_no_delay_today(b):
    return jobs.delay_notifications(b.shipments, b.tracking_events, AS_OF_EVENTS, 2).select("shipment_id", "event_type")


@query
def c19_lookups(b):
    found = {
        "tracking": filters.by_tracking_numbers(b.shipments, "GT-0000000007", "GT-0000000008"),
        "bill of lading": filters.by_bill_of_lading(b.shipments, "BL0000000050"),
        "container": filters.by_container(b.cargo, "CONT0000616"),
        "voyage": filters.by_voyage(b.port_calls, "", ""),
        "late call": filters.calls_later_than(b.port_calls, Decimal("100")),
        "hazmat": filters.hazmat_in_transit(b.cargo, b.shipments),
        "reefer": filters.reefer_below(b.cargo, Decimal("-10")),
        "lane": filters.on_lane(b.shipments, 3, 4),
        "valid route": filters.routes_valid_on(b.routes, "2000-06-01"),
        "name": filters.name_like(b.companies, "legal_name", "CUSTOMER#00000001"),
    }
    return union_all([df.select(F.lit(test).alias("test"), F.col("id").cast("string").alias("id")) for test, df in found.items()])


@query
def c19_similar_names(b):
    """The three companies whose names are most like those of every hundredth, misspelt and with its tax id."""
    wanted = b.companies.filter("id % 100 = 0").select("id", F.concat(F.regexp_replace("legal_name", "Customer", "Custmer"), F.lit(" & "), F.col("tax_id")).alias("text"))
    held = materialized(names.gram_index(b.companies.withColumn("name", F.concat_ws(" ", "legal_name", "tax_id")), "id", "name")[0])
    return names.search((held, names.postings(held)), wanted, "id", "text", names.ALIKE, 3).select("query", "key", "similarity")


@query
def c19_nested_containment(b):
    """Shipments whose nested record has a booked lane from port 3, a frozen item and a dangerous one, in any order."""
    item = F.struct(F.col("cargo_type").alias("type"), F.struct(F.col("is_hazmat").alias("hazmat"), F.col("package_count").alias("packages")).alias("handling"))
    items = b.cargo.groupBy(F.col("shipment_id").alias("id")).agg(F.collect_list(item).alias("items"))
    record = F.to_json(F.struct(F.struct(F.struct(F.col("origin_port_id").alias("from"), F.col("destination_port_id").alias("to")).alias("ports"), F.col("status")).alias("lane"), "items"))
    kept = b.shipments.join(items, "id").select("id", record.alias("record"))
    wanted = {"lane": {"ports": {"from": 3.0}}, "items": [{"handling": {"hazmat": True}}, {"type": "REEFER"}]}
    return containment.containing(kept, "record", wanted).select("id")


@query
def c19_json_and_codes(b):
    wanted = filters.json_contains(b.shipments, "custom_attributes", idempotency_key="key-0000000040")
    both = filters.with_hs_codes(b.shipments, "8471.30", "8473.30")
    return wanted.select(F.lit("json").alias("test"), "id").unionByName(both.select(F.lit("codes").alias("test"), "id"))


# joins


@query
def d1_with_carrier(b):
    return joins.with_carrier(b.shipments, b.carriers, b.companies).select("id", "carrier_name", "carrier_mode", "carrier_company_legal_name")


@query
def d2_with_route(b):
    return joins.with_route(b.shipments, b.routes, b.ports).select("id", "route_code", "route_origin_port_name", "route_destination_un_locode")


@query
def d3_with_shipment(b):
    return joins.with_shipment(b.tracking_events, b.shipments, b.carriers, b.ports).select("id", "tracking_number", "carrier_name", "port_name")


@query
def d4_with_company(b):
    return joins.with_company(b.carriers, b.companies).select("id", "company_legal_name", "company_country_code")


@query
def d6_with_latest_event(b):
    return joins.with_latest_event(b.shipments, b.tracking_events).select("id", "latest_event_time")


@query
def d7_latest_port_call(b):
    return b.routes.select(F.col("id").alias("route_id")).join(joins.latest_port_calls(b.port_calls), "route_id", "left")


@query
def d8_later_exceptions_per_shipment(b):
    return reports.cascades(b.tracking_events, b.shipments, AS_OF_EVENTS, 30, 48)


@query
def d9_events_around_calls(b):
    calls = b.port_calls.select("port_id", "scheduled_arrival").distinct()
    seen = b.tracking_events.groupBy("port_id", F.unix_micros("event_time").alias("at")).agg(F.count("*").alias("n_events"), F.count_if("is_exception").alias("n_exceptions"))
    at, reach = F.unix_micros("scheduled_arrival"), F.lit(2 * 86_400_000_000)
    return intervals.counts_in_ranges(calls, seen, ["port_id"], ["n_events", "n_exceptions"], at - reach, at + reach)


@query
def d10_cargo_totals(b):
    return joins.cargo_totals(b.cargo)


@query
def d13_cargo_pages(b):
    pages = projections.cargo_pages(b.cargo, page_size=3)
    return pages.select("shipment_id", "cargo_page", F.array_join(F.transform("cargo_items", lambda i: i["id"]), ",").alias("items"))


# quality


def _all_tables(b: Bindings) -> dict[str, DataFrame]:
    names = ["companies", "ports", "carriers", "routes", "shipments", "cargo", "tracking_events", "port_calls"]
    return {name: getattr(b, name) for name in names}


@query
def e1_e2_row_violations(b):
    return union_all([quality.row_violations(df, name) for name, df in _all_tables(b).items()])


@query
def e3_unique_violations(b):
    stored = _all_tables(b)
    return union_all([quality.unique_violations(df, name) for name, df in stored.items() if name in quality.UNIQUE_RULES])


@query
def e3_reference_violations(b):
    stored = _all_tables(b)
    return union_all([quality.reference_violations(stored, name) for name in ("carriers", "routes", "shipments", "cargo", "tracking_events", "port_calls")])


def _status_log(b: Bindings) -> DataFrame:
    """A change log over the events: each event asks for a status."""
    asked = F.element_at(F.array(*[F.lit(s) for s in ("BOOKED", "IN_TRANSIT", "AT_PORT", "EXCEPTION", "DELIVERED", "IN_TRANSIT", "CUSTOMS_HOLD")]), (F.pmod("id", F.lit(7)) + 1).cast("int"))
    events = b.tracking_events
    return events.select("id", "shipment_id", F.col("event_time").alias("changed_at"), asked.alias("status"))


@query
def e4_illegal_moves(b):
    return quality.illegal_moves(_status_log(b))


def _bookings(b: Bindings) -> DataFrame:
    """A booking request per order, with faults spread over them by key."""
    k = F.col("id")

    def every(n: int, at: int) -> Column:
        return F.pmod(k, F.lit(n)) == at

    empty = F.lit(None).cast("long")
    return b.shipments.select(
        F.concat(F.lit("bk-"), F.floor(k / 2).cast("string")).alias("idempotency_key"),
        "shipper_id",
        "consignee_id",
        "notify_party_id",
        F.when(every(29, 1), F.lit(-1)).otherwise(F.col("carrier_id")).alias("carrier_id"),
        F.when(every(31, 2), F.lit(-1)).otherwise(F.col("route_id")).alias("route_id"),
        F.when(every(17, 3), F.col("origin_port_id") + 1).otherwise(F.col("origin_port_id")).alias("origin_port_id"),
        F.when(every(19, 4), empty).otherwise(F.col("destination_port_id")).alias("destination_port_id"),
        "departure_date",
        F.when(every(23, 5), F.col("departure_date")).otherwise(F.col("estimated_arrival")).alias("estimated_arrival"),
        F.when(every(41, 6), -F.col("declared_value")).otherwise(F.col("declared_value")).cast("decimal(18,2)").alias("declared_value"),
        "freight_cost",
        F.when(every(13, 7), F.lit("U5D")).when(every(13, 8), F.lit("eur")).otherwise(F.col("currency_code")).alias("currency_code"),
    )


@query
def e5_checked_bookings(b):
    checked = quality.check_bookings(_bookings(b), b.carriers, b.routes, C.instant(AS_OF))
    return checked.groupBy("error", "currency_code").agg(F.count("*").alias("n"), F.sum("shipper_id").alias("shippers"))


@query
def e5_bookings_by_row(b):
    checked = quality.check_bookings(_bookings(b), b.carriers, b.routes, C.instant(AS_OF))
    return checked.select("idempotency_key", "shipper_id", "carrier_id", "route_id", "departure_date", "declared_value", "currency_code", "error")


@query
def e6_checked_cargo(b):
    return quality.check_cargo(b.cargo).select("id", "error")


@query
def e7_checked_events(b):
    events = b.tracking_events.select(
        "id",
        "shipment_id",
        "event_type",
        "event_time",
        F.when(F.pmod("id", F.lit(2)) == 0, F.lit("at berth")).otherwise("").alias("description"),
        "is_exception",
        F.when(F.col("is_exception") & (F.pmod("id", F.lit(4)) < 3), F.lit("crane broke")).otherwise("").alias("exception_description"),
    )
    return quality.check_events(events, b.shipments, C.instant("2024-01-20 00:00:00")).select("id", "description", "error")


def _messages(b: Bindings) -> DataFrame:
    """A signed carrier message per event; some are forged, cut short, sent twice or name no shipment."""
    e = F.col("id")
    owner = b.shipments.select(F.col("id").alias("shipment_id"), "tracking_number", "carrier_id")
    secret = F.get_json_object("service_metadata", "$.webhook_secret")
    true_pads, wrong_pads = (F.struct(*[p.alias(n) for p, n in zip(pads(key), ("inner", "outer"), strict=True)]) for key in (secret, F.lit("wrong")))
    secrets = b.carriers.select(F.col("id").alias("carrier_id"), "carrier_code", true_pads.alias("pads"), wrong_pads.alias("wrong_pads"))
    sent = b.tracking_events.join(owner, "shipment_id").join(secrets, "carrier_id")
    reference = F.when(F.pmod(e, F.lit(11)) == 0, F.concat(F.lit("LOST-"), e.cast("string"))).otherwise(F.col("tracking_number"))
    body = F.to_json(
        F.struct(
            F.concat(F.lit("m"), F.floor(e / 2).cast("string")).alias("webhook_id"),
            F.when(F.pmod(e, F.lit(13)) != 0, F.col("event_type")).alias("event_type"),
            reference.alias("shipment_reference"),
            jobs.iso(F.col("event_time")).alias("event_timestamp"),
            F.create_map(F.lit("port"), F.col("port_id").cast("string")).alias("payload"),
        )
    )
    raw = F.encode(body, "UTF-8")
    forged = F.pmod(e, F.lit(17)) == 0
    used = F.when(forged, F.col("wrong_pads")).otherwise(F.col("pads"))
    code = F.when(F.pmod(e, F.lit(19)) == 0, F.lit("NOBODY")).otherwise(F.col("carrier_code"))
    return sent.select(code.alias("carrier_code"), raw.alias("raw_body"), signature(raw, used["inner"], used["outer"]).alias("signature"), F.col("event_time").alias("received_at"))


@query
def e8_e9_message_outcomes(b):
    parsed = ingest.parse(_messages(b), b.carriers)
    return parsed.groupBy("reason").agg(F.count("*").alias("n"), F.min("received_at").alias("first_at"), F.max("received_at").alias("last_at"))


@query
def e8_messages_by_row(b):
    parsed = ingest.parse(_messages(b), b.carriers)
    return parsed.select("carrier_code", "received_at", F.when(F.col("reason").isNull(), F.col("webhook_id")).alias("webhook_id"), "reason")


@query
def c14_departed_through(b):
    criteria = ShipmentCriteria(departure_after="1997-01-01", departure_through="1997-03-31")
    return filters.matching(b.shipments, criteria, AS_OF).select("id", "departure_date")


@query
def h2_recent_trend_corrected(b):
    return reports.recent_volume_trend_corrected(b.shipments, AS_OF, 6)


@query
def h13_transit_percentiles_corrected(b):
    return reports.transit_percentiles_corrected(b.shipments)


@query
def h13_percentiles_from_sketches(b):
    """Percentiles and customers of 1996 from merged daily sketches: how many deliveries each carrier had, and whether every figure is as near as stated."""
    found = sketches.between(sketches.daily_sketches(b.shipments), "1996-01-01", "1996-12-31")
    exact = sketches.delivered_days(b.shipments).filter("year(day) = 1996").join(found, "carrier_id")
    share = lambda test: F.count_if(test) / F.count(F.lit(1))

    def near(figure: str, rank: float) -> Column:
        return (share(F.col("transit_days") < F.col(figure)) <= rank + 0.02) & (share(F.col("transit_days") <= F.col(figure)) >= rank - 0.02)

    customers = F.count_distinct("shipper_id")
    return exact.groupBy("carrier_id").agg(
        F.first("sample_size").alias("sample_size"),
        near("median_days", 0.5).alias("median_near"),
        near("p95_days", 0.95).alias("p95_near"),
        (F.abs(F.first("customers") - customers) <= customers * 0.05 + 1).alias("customers_near"),
    )


@query
def h13_percentiles_of_two_carriers(b):
    """One carrier of the fleet and one id that no delivery has."""
    return reports.transit_percentiles(b.shipments, 7, -1)


# derived columns


@query
def f1_transit_duration(b):
    timed = derive.with_transit_duration(b.shipments, AS_OF)
    micros = C.elapsed_micros(C.instant("1970-01-01") + F.col("transit_duration"), C.instant("1970-01-01"))
    return timed.select("id", (micros / F.lit(1_000_000)).cast("long").alias("transit_seconds"))


@query
def f2_delay_flag(b):
    return derive.with_delay_flag(b.shipments, AS_OF).select("id", "is_delayed")


@query
def f3_value_tier(b):
    return derive.with_value_tier(b.shipments).select("id", "value_tier")


@query
def f5_cargo_summary(b):
    return joins.with_cargo_summary(b.shipments, b.cargo).select("id", "total_gross_weight_kg", "total_packages")


@query
def f6_hours_overdue(b):
    return derive.with_hours_overdue(filters.delayed(b.shipments, AS_OF), AS_OF).select("id", "hours_overdue")


@query
def f7_tracking_numbers(b):
    return b.shipments.select("id", C.tracking_number("id").alias("tracking_number"))


@query
def f8_event_for_status(b):
    return b.shipments.groupBy("status").agg(F.count("*").alias("n")).select("status", C.event_for_status("status").alias("event_type"), "n")


@query
def f9_month_bounds(b):
    return b.shipments.select("id", C.month_start(F.to_date("departure_date")).alias("month_start"), C.month_end(F.to_date("departure_date")).alias("month_end"))


# windows


def _narrow(b: Bindings, *extra: str) -> DataFrame:
    return b.shipments.select("id", "carrier_id", "departure_date", *extra)


@query
def g1_running_total_value(b):
    return windows.with_running_total_value(_narrow(b, "declared_value")).select("id", "running_total_value")


@query
def g2_carrier_rank_by_volume(b):
    return windows.with_carrier_rank_by_volume(_narrow(b)).select("id", "carrier_shipment_count", "carrier_volume_rank")


@query
def g3_row_number_by_carrier(b):
    return windows.with_row_number_by_carrier(_narrow(b)).select("id", "carrier_row_num")


@query
def g3_first_two_per_carrier(b):
    return windows.top_per_carrier(_narrow(b), 2).select("id", "carrier_id", "carrier_row_num")


@query
def g4_lag_arrival(b):
    return windows.with_lag_arrival(_narrow(b, "actual_arrival")).select("id", "prev_arrival")


@query
def g5_percentile_rank_by_weight(b):
    weighed = joins.with_cargo_summary(b.shipments.select("id"), b.cargo)
    return windows.with_percentile_rank_by_weight(weighed).select("id", "weight_percentile_rank")


@query
def g6_quartile_by_value(b):
    return windows.with_quartile_by_value(_narrow(b, "declared_value")).select("id", "value_quartile")


@query
def g7_moving_avg_value(b):
    return windows.with_moving_avg_value(_narrow(b, "declared_value")).select("id", "moving_avg_value")


@query
def g7_moving_avg_value_30_days(b):
    return windows.with_moving_avg_value(_narrow(b, "declared_value"), window_days=30).select("id", "moving_avg_value")


# reports


@query
def h1_carrier_performance(b):
    return reports.carrier_performance_summary(b.shipments, b.cargo, b.carriers, AS_OF)


@query
def h1_carrier_performance_corrected(b):
    return reports.carrier_performance_summary_corrected(b.shipments, b.cargo, b.carriers, AS_OF)


@query
def h2_monthly_volume_trend(b):
    return reports.monthly_volume_trend(b.shipments)


@query
def h2_recent_volume_trend(b):
    return reports.recent_volume_trend(b.shipments, AS_OF, 12)


@query
def h3_route_utilization(b):
    return _utilization(reports.route_utilization(b.shipments, b.routes, AS_OF))


def _utilization(df: DataFrame) -> DataFrame:
    epoch = C.instant("1970-01-01")
    seconds = C.elapsed_micros(epoch + F.col("avg_transit_days"), epoch) / F.lit(1_000_000.0)
    return df.withColumn("avg_transit_seconds", seconds).drop("avg_transit_days")


@query
def h4_exception_rate_by_carrier(b):
    return reports.exception_rate_by_carrier(b.tracking_events, b.shipments, b.carriers)


@query
def h5_on_time_rate(b):
    return reports.on_time_rate(b.shipments, "carrier_id")


@query
def h6_carriers_with_counts(b):
    return joins.with_shipment_counts(b.carriers, b.shipments).select("id", "shipment_count")


@query
def h7_ports_with_counts(b):
    return joins.with_call_counts(b.ports, b.port_calls).select("id", "port_call_count")


@query
def h8_dashboard_summary(b):
    return projections.summary_view(reports.dashboard_summary(b.shipments, AS_OF))


@query
def h9_top_routes(b):
    return _utilization(reports.top_routes(b.shipments, b.routes, AS_OF_LAST, 10))


@query
def h10_carrier_leaderboard(b):
    return reports.carrier_leaderboard(b.shipments, b.cargo, b.carriers, AS_OF)


@query
def h10_carrier_leaderboard_corrected(b):
    return reports.carrier_leaderboard_corrected(b.shipments, b.cargo, b.carriers, AS_OF)


@query
def h11_active_by_mode(b):
    return reports.active_by_mode(b.carriers, b.companies, b.shipments, "SEA").select("id", "company_legal_name", "shipment_count")


@query
def h12_hub_coverage(b):
    return reports.hub_coverage(b.carriers, b.companies, b.shipments, "APN15").select("id", "company_legal_name", "shipment_count")


@query
def h13_transit_percentiles(b):
    return reports.transit_percentiles(b.shipments)


@query
def h13_transit_percentiles_one_carrier(b):
    return reports.transit_percentiles(b.shipments, 7)


@query
def h14_top_lanes(b):
    return reports.top_lanes_by_volume(b.shipments, b.routes, b.port_calls, AS_OF_LAST, 10, 90)


@query
def h15_exception_cascades(b):
    return reports.exception_cascades(b.tracking_events, b.shipments, AS_OF_EVENTS, 30)


@query
def h16_read_carrier_stats(b):
    daily = _published(b, "mv_carrier_daily_stats").read(since="1996-01-01", until="1998-12-31")
    return reports.read_carrier_stats(daily, 7, "1996-01-01", "1998-12-31")


@query
def h17_read_port_congestion(b):
    return reports.read_port_congestion(_published(b, "mv_port_congestion").read(), AS_OF_EVENTS, None, 4)


@query
def h17_read_port_congestion_one_port(b):
    return reports.read_port_congestion(_published(b, "mv_port_congestion").read(), AS_OF_EVENTS, 8, 4)


# materialized views


@query
def i1_carrier_daily_stats(b):
    return matviews.carrier_daily_stats(b.shipments, b.cargo, b.tracking_events, AS_OF)


@query
def i1_carrier_daily_stats_corrected(b):
    return matviews.carrier_daily_stats_corrected(b.shipments, b.cargo, b.tracking_events, AS_OF)


@query
def i2_route_monthly_performance(b):
    return matviews.route_monthly_performance(b.shipments)


@query
def i1_carrier_stats_after_changes(b):
    """The daily view kept as parts, after a day's changes: some shipments revalued, moved to another day or deleted."""
    was = b.shipments.filter("id % 5 = 0")
    now = was.filter("id % 15 <> 0").withColumns(
        {"declared_value": (F.col("declared_value") * 2).cast("decimal(18,2)"), "departure_date": F.when(F.pmod("id", F.lit(2)) == 0, F.col("departure_date") + F.expr("interval 3 days")).otherwise(F.col("departure_date"))}
    )
    parts = lambda shipments: matviews.carrier_daily_parts(shipments, b.cargo, b.tracking_events, AS_OF)
    return matviews.carrier_daily_finish(matviews.with_changes(parts(b.shipments), parts(was), parts(now), matviews.KEYS["mv_carrier_daily_stats"]))


@query
def i3_port_congestion(b):
    return matviews.port_congestion(b.port_calls, b.tracking_events)


@query
def i3_port_congestion_corrected(b):
    return matviews.port_congestion_corrected(b.port_calls, b.tracking_events)


# snapshots and jobs


@query
def j1_carrier_snapshots(b):
    return snapshots.carrier_snapshots(b.shipments, b.carriers, DAY, AS_OF).drop("id")


@query
def j2_route_snapshots(b):
    return snapshots.route_snapshots(b.shipments, b.routes, DAY).drop("id")


@query
def j3_global_snapshots(b):
    return snapshots.global_snapshots(b.shipments, DAY, AS_OF).drop("id")


@query
def j4_delay_events(b):
    return jobs.delay_notifications(b.shipments, b.tracking_events, AS_OF, 2)


@query
def j4_delay_counts(b):
    return jobs.delay_counts(b.shipments, b.tracking_events, "2024-01-12 12:00:00", 2)


def _parsed_messages(b: Bindings) -> DataFrame:
    """Parsed messages over the events, some sent twice, some naming no shipment or carrier."""
    e = F.col("id")
    owner = b.shipments.select(F.col("id").alias("shipment_id"), "tracking_number", "carrier_id")
    sent = b.tracking_events.join(owner, "shipment_id").join(b.carriers.select(F.col("id").alias("carrier_id"), "carrier_code"), "carrier_id")
    return sent.select(
        F.concat(F.lit("w"), F.when(F.pmod(e, F.lit(5)) == 0, e).otherwise(F.floor(e / 2) + 1_000_000_000_000).cast("string")).alias("webhook_id"),
        F.when(F.pmod(e, F.lit(19)) == 0, F.lit("NOBODY")).otherwise(F.col("carrier_code")).alias("carrier_code"),
        "event_type",
        F.when(F.pmod(e, F.lit(11)) == 0, F.concat(F.lit("LOST-"), e.cast("string"))).otherwise(F.col("tracking_number")).alias("shipment_reference"),
        F.col("event_time").alias("event_timestamp"),
        F.create_map(F.lit("port"), F.col("port_id").cast("string")).alias("payload"),
        F.col("event_time").alias("received_at"),
        F.lit(0).alias("retries"),
    )


@query
def j5_match_messages(b):
    matched = jobs.match_messages(_parsed_messages(b), jobs.processed_webhooks(b.tracking_events), b.carriers, b.shipments, C.instant("2024-01-20 00:00:00"))
    return matched.select("webhook_id", "carrier_code", "shipment_reference", "shipment_id", "status")


def _change_log(b: Bindings) -> DataFrame:
    log = _status_log(b).withColumnRenamed("status", "new_status")
    return log.withColumns({"note": F.when(F.pmod("id", F.lit(9)) == 0, F.lit("by phone")), "event_location": F.lit("")})


@query
def j6_resolved_changes(b):
    return jobs.resolve_changes(_change_log(b), b.shipments, block=2).select("id", "shipment_id", "old_status", "new_status", "outcome")


@query
def j6_next_shipments(b):
    resolved = jobs.resolve_changes(_change_log(b), b.shipments)
    return jobs.apply_changes(b.shipments, resolved).select("id", "status", "actual_arrival", "updated_at")


@query
def j6_change_events(b):
    return jobs.change_events(jobs.resolve_changes(_change_log(b), b.shipments)).drop("id")


@query
def j7_accepted_bookings(b):
    accepted = jobs.accept_bookings(_bookings(b), b.shipments, b.carriers, b.routes, C.instant(AS_OF))
    return accepted.select("shipper_id", "route_id", "tracking_number", "status", "departure_date", "declared_value", "currency_code", "custom_attributes")


@query
def j7_booking_events(b):
    accepted = jobs.accept_bookings(_bookings(b), b.shipments, b.carriers, b.routes, C.instant(AS_OF))
    return jobs.booking_events(accepted).groupBy("event_type", "description", "event_time").agg(F.count("*").alias("n"))


@query
def j8_current_events(b):
    return filters.not_superseded(b.tracking_events).select("id", "event_type")


# streaming operators in batch form, and pages


@query
def k1_ingested_events(b):
    now = C.instant(AS_OF_EVENTS)
    taken = ingest.accepted(ingest.parse(_messages(b), b.carriers))
    matched = jobs.match_messages(taken, jobs.processed_webhooks(b.tracking_events), b.carriers, b.shipments, now)
    return jobs.message_events(matched, now).select("shipment_id", "event_type", "event_time", "recorded_at", "description", "source_system")


@query
def k1_keyed_events(b):
    """The ingest on keyed state over a stream of the same messages: its event log, but for the time of recording."""
    spark = b.shipments.sparkSession
    folder = run_folder(spark)
    sent = _messages(b)
    with shuffle_files_deleted(spark):
        sent.write.parquet(f"{folder}/sent")
    handled = materialized(jobs.processed_webhooks(b.tracking_events))
    handler = keyed_ingest.KeyedIngest(f"{folder}/out", lambda: (handled, b.carriers, b.shipments))
    handler.start(spark.readStream.schema(sent.schema).parquet(f"{folder}/sent"), f"{folder}/checkpoint", once=True).awaitTermination()
    return handler.log(spark).select("shipment_id", "event_type", "event_time", "description", "source_system")


@query
def k1_two_batches(b):
    """The stateful ingest over two consecutive batches: its event log."""
    spark, sent = b.shipments.sparkSession, _messages(b)
    webhook = F.get_json_object(F.decode("raw_body", "UTF-8"), "$.webhook_id")
    handler = ingest.Ingest(run_folder(spark), lambda: (jobs.processed_webhooks(b.tracking_events), b.carriers, b.shipments), lambda: C.instant(AS_OF_EVENTS))
    for batch in range(2):
        handler(sent.filter(F.pmod(F.crc32(webhook.cast("binary")), F.lit(2)) == batch), batch)
    return handler.log(spark).select("shipment_id", "event_type", "event_time", "recorded_at", "description", "source_system")


@query
def k3_merged_cascades(b):
    """The cascade monitor over two batches that lie in each other's reach: its merged totals."""
    spark = b.shipments.sparkSession
    monitor = monitors.CascadeMonitor(run_folder(spark), lambda: b.shipments)
    for batch in range(2):
        monitor(b.tracking_events.filter(F.pmod("id", F.lit(2)) == batch), batch)
    return monitor.totals(spark)


@query
def j8_correction_chains(b):
    """Chains of up to seven corrections: the event each begins with, how far it is, and whether it is the last."""
    corrected = b.tracking_events.select("id", F.when(F.pmod("id", F.lit(8)) > 0, F.col("id") - F.when(F.pmod("id", F.lit(24)) == 5, 2).otherwise(1)).alias("supersedes_id"))
    return chains.correction_chains(corrected)


@query
def k2_exception_windows_by_port(b):
    return monitors.exception_windows(b.tracking_events, "port_id", "1 day")


@query
def k2_exception_windows_by_carrier(b):
    owned = b.tracking_events.join(b.shipments.select(F.col("id").alias("shipment_id"), "carrier_id"), "shipment_id")
    return monitors.exception_windows(owned, "carrier_id", "7 days", monitors.MONDAY)


@query
def k4_late_events(b):
    in_time, late = monitors.split_late(b.tracking_events, 24)
    both = [monitors.with_lag(df).select("id", "lag_seconds", F.lit(name).alias("kind")) for name, df in (("in time", in_time), ("late", late))]
    return union_all(both)


@query
def l4_first_page(b):
    return paging.page(_narrow(b), size=50)


@query
def l4_next_page(b):
    return paging.page(_narrow(b), after=paging.Cursor("1999-01-01 00:00:00", 5000), size=200)
