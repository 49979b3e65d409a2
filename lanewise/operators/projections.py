"""Listing and detail views of shipments, cargo and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.functions import columns as C
from lanewise.functions import domain
from lanewise.operators import joins
from lanewise.operators.ordering import Key, positions, union_all
from lanewise.sources.checkpoints import materialized, shuffle_files_deleted

#: Items of a shipment that one task numbers.
MOST_IN_A_TASK = 1 << 16


def shipment_list(shipments: DataFrame, carriers: DataFrame, routes: DataFrame, ports: DataFrame, as_of: str) -> DataFrame:
    """Thirteen columns per shipment; both ports are the route's."""
    joined = joins.with_route(joins.with_carrier(shipments, carriers), routes, ports)
    return joined.select(
        "id",
        "tracking_number",
        "status",
        C.label("status", domain.SHIPMENT_STATUSES).alias("status_display"),
        "carrier_name",
        C.label("carrier_mode", domain.CARRIER_MODES).alias("carrier_mode"),
        F.struct(F.col("route_origin_un_locode").alias("un_locode"), F.col("route_origin_port_name").alias("port_name")).alias("origin_port"),
        F.struct(F.col("route_destination_un_locode").alias("un_locode"), F.col("route_destination_port_name").alias("port_name")).alias("destination_port"),
        "declared_value",
        "currency_code",
        "departure_date",
        "estimated_arrival",
        C.is_delayed(as_of).alias("is_delayed"),
    )


_CARGO = (
    "id",
    "shipment_id",
    "cargo_type",
    "cargo_type_display",
    "description",
    "container_number",
    "gross_weight_kg",
    "net_weight_kg",
    "volume_cbm",
    "package_count",
    "package_type",
    "is_hazmat",
    "un_number",
    "temperature_min_c",
    "temperature_max_c",
)


def _cargo_column(name: str) -> Column:
    return C.label("cargo_type", domain.CARGO_TYPES).alias(name) if name == "cargo_type_display" else F.col(name)


def cargo_view(cargo: DataFrame) -> DataFrame:
    return cargo.select(*map(_cargo_column, _CARGO))


def event_timeline(events: DataFrame, ports: DataFrame) -> DataFrame:
    """Events with their port's name; audit columns (raw payload, source) stay out."""
    named = events.join(ports.select(F.col("id").alias("port_id"), "port_name"), "port_id", "left")
    return named.select(
        "id",
        "shipment_id",
        "event_type",
        C.label("event_type", domain.EVENT_TYPES).alias("event_type_display"),
        "event_time",
        "recorded_at",
        "port_name",
        "location_description",
        "description",
        "is_exception",
        "exception_resolved",
    )


def cargo_pages(cargo: DataFrame, page_size: int = 500) -> DataFrame:
    """Cargo nested per shipment in pages of at most ``page_size`` items, in id order.

    A shipment's items are whole over its pages, and no page grows with the shipment. Only the items of shipments with more than a page are numbered.
    Items are shuffled once, by shipment; those of a shipment with more than ``MOST_IN_A_TASK`` are numbered by ranges, so that it need not fit one task.
    """
    spark, items = cargo.sparkSession, cargo.select(*[c for c in _CARGO if c != "cargo_type_display"])  # labels are added after the shuffle
    nested = F.sort_array(F.collect_list(F.struct(*[_cargo_column(c) for c in _CARGO if c != "shipment_id"]))).alias("cargo_items")
    first = F.lit(0).cast("long").alias("cargo_page")
    counts = cargo.groupBy("shipment_id").agg(F.count("*").alias("_items"))
    with shuffle_files_deleted(spark):
        most = counts.agg(F.max("_items")).first()[0] or 0
    if most <= page_size:
        return items.groupBy("shipment_id").agg(nested).select("shipment_id", first, "cargo_items")
    page = F.floor((F.col("_at") - 1) / page_size).cast("long").alias("cargo_page")
    paged = lambda placed: placed.groupBy("shipment_id", page).agg(nested)
    frames = []
    if most > max(page_size, MOST_IN_A_TASK):
        with shuffle_files_deleted(spark):
            large = F.broadcast(materialized(counts.filter(F.col("_items") > max(page_size, MOST_IN_A_TASK)).select(F.col("shipment_id").alias("_large"))))
        is_large = F.col("shipment_id").eqNullSafe(F.col("_large"))
        frames.append(paged(positions(items.join(large, is_large, "left_semi"), [Key("id")], ["shipment_id"], into="_at")))
        items = items.join(large, is_large, "left_anti")
    # both windows and both groupings need the items by shipment only, so they share one shuffle
    sized = items.withColumn("_items", F.count("*").over(Window.partitionBy("shipment_id")))
    long = sized.filter(F.col("_items") > page_size).drop("_items")
    frames.append(paged(positions(long, [Key("id")], ["shipment_id"], into="_at", whole=True)))
    one_page = sized.filter(F.col("_items") <= page_size).groupBy("shipment_id").agg(nested)
    return union_all([*frames, one_page.select("shipment_id", first, "cargo_items")])


def shipment_detail(shipments: DataFrame, carriers: DataFrame, companies: DataFrame, cargo: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Full detail with latest event, duration in whole seconds and the number of cargo items.

    One row per shipment, whatever it carries; the items themselves are ``cargo_pages``.
    """
    counts = cargo.groupBy(F.col("shipment_id").alias("id")).agg(F.count("*").alias("cargo_count"))
    joined = joins.with_latest_event(shipments.join(counts, "id", "left"), events)
    # both names are looked up for the pairs that occur, so that the whole rows are shuffled once for the two
    firms = shipments.select("shipper_id", "consignee_id").distinct()
    for role in ("shipper", "consignee"):
        firms = firms.join(companies.select(F.col("id").alias(f"{role}_id"), F.col("legal_name").alias(f"{role}_name")), f"{role}_id")
    joined = joins.with_carrier(joined, carriers).join(firms, ["shipper_id", "consignee_id"])
    end = F.coalesce(F.col("actual_arrival"), C.instant(as_of))
    return joined.select(
        "id",
        "tracking_number",
        "bill_of_lading",
        "house_bill_of_lading",
        "status",
        C.label("status", domain.SHIPMENT_STATUSES).alias("status_display"),
        "carrier_name",
        C.label("carrier_mode", domain.CARRIER_MODES).alias("carrier_mode"),
        "shipper_name",
        "consignee_name",
        "origin_port_id",
        "destination_port_id",
        "declared_value",
        "freight_cost",
        "currency_code",
        "incoterms",
        "booking_date",
        "departure_date",
        "estimated_arrival",
        "actual_arrival",
        C.elapsed_seconds(end, F.col("departure_date")).alias("transit_duration_seconds"),
        "latest_event_time",
        "hs_codes",
        "tags",
        "notes",
        F.coalesce("cargo_count", F.lit(0)).alias("cargo_count"),
        "created_at",
        "updated_at",
    )


def leaderboard_view(leaderboard: DataFrame) -> DataFrame:
    """Fixed output types of the leaderboard."""
    return leaderboard.select(
        "carrier_id",
        "carrier_name",
        F.col("shipment_count").cast("long").alias("shipment_count"),
        F.col("delay_rate_pct").cast("decimal(6,2)").alias("delay_rate_pct"),
        F.col("avg_declared_value").cast("decimal(18,2)").alias("avg_declared_value"),
        F.col("total_gross_weight_kg").cast("decimal(18,3)").alias("total_gross_weight_kg"),
        F.col("volume_rank").cast("long").alias("volume_rank"),
    )


def trend_view(trend: DataFrame) -> DataFrame:
    return trend.select("month", F.col("shipment_count").cast("long").alias("shipment_count"), F.col("total_declared_value").cast("decimal(20,2)").alias("total_declared_value"))


def summary_view(summary: DataFrame) -> DataFrame:
    return summary.select("total", "active", "delayed", F.col("total_declared_value").cast("decimal(22,2)").alias("total_declared_value"))
