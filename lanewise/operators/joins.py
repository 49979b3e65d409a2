"""Lookups and child totals.

Nothing here carries a broadcast hint: Spark broadcasts a side when its statistics are under
``spark.sql.autoBroadcastJoinThreshold`` and otherwise shuffles, where the adaptive skew join
splits a hot key. Child tables are totalled per parent before they are joined, so no join fans out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefixed(df: DataFrame, prefix: str, *columns: str, key: str | None = None) -> DataFrame:
    """``columns`` renamed to ``prefix_column``; ``id`` becomes ``key`` (default ``prefix_id``)."""
    return df.select(F.col("id").alias(key or f"{prefix}_id"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def with_carrier(shipments: DataFrame, carriers: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Carrier name and mode, and the owning company's name when companies are given."""
    side = carriers.select(F.col("id").alias("carrier_id"), "carrier_name", F.col("mode").alias("carrier_mode"), F.col("company_id").alias("carrier_company_id"))
    out = shipments.join(side, "carrier_id")
    if companies is None:
        return out
    return out.join(prefixed(companies, "carrier_company", "legal_name"), "carrier_company_id")


def with_company(carriers: DataFrame, companies: DataFrame) -> DataFrame:
    return carriers.join(prefixed(companies, "company", "legal_name", "country_code"), "company_id")


def with_route(shipments: DataFrame, routes: DataFrame, ports: DataFrame) -> DataFrame:
    """Route code and both terminal ports, taken from the route (a shipment may disagree with its route)."""
    lanes = (
        routes.select(
            F.col("id").alias("route_id"),
            "route_code",
            F.col("origin_port_id").alias("route_origin_id"),
            F.col("destination_port_id").alias("route_destination_id"),
        )
        .join(prefixed(ports, "route_origin", "un_locode", "port_name"), "route_origin_id")
        .join(prefixed(ports, "route_destination", "un_locode", "port_name"), "route_destination_id")
    )
    return shipments.join(lanes, "route_id")


def with_shipment(events: DataFrame, shipments: DataFrame, carriers: DataFrame, ports: DataFrame) -> DataFrame:
    """Events with their shipment's number, its carrier, and the port's name where there is a port."""
    side = with_carrier(shipments.select(F.col("id").alias("shipment_id"), "tracking_number", "status", "carrier_id"), carriers)
    out = events.join(side.withColumnRenamed("status", "shipment_status"), "shipment_id")
    return out.join(prefixed(ports, "port", "port_name").withColumnRenamed("port_port_name", "port_name"), "port_id", "left")


def cargo_totals(cargo: DataFrame) -> DataFrame:
    return cargo.groupBy("shipment_id").agg(
        F.sum("gross_weight_kg").cast("decimal(16,3)").alias("total_gross_weight_kg"),
        F.sum("package_count").cast("long").alias("total_packages"),
        F.count("*").alias("cargo_rows"),
    )


def with_cargo_summary(shipments: DataFrame, cargo: DataFrame) -> DataFrame:
    """Total weight and packages, 0 where a shipment has no cargo."""
    totals = cargo_totals(cargo).drop("cargo_rows").withColumnRenamed("shipment_id", "id")
    zero = F.lit(0)
    return shipments.join(totals, "id", "left").withColumns(
        {
            "total_gross_weight_kg": F.coalesce("total_gross_weight_kg", zero.cast("decimal(16,3)")),
            "total_packages": F.coalesce("total_packages", zero.cast("long")),
        }
    )


def event_totals(events: DataFrame) -> DataFrame:
    return events.groupBy("shipment_id").agg(
        F.count("*").alias("event_rows"),
        F.count_if("is_exception").alias("exception_rows"),
        F.max("event_time").alias("latest_event_time"),
    )


def with_latest_event(shipments: DataFrame, events: DataFrame) -> DataFrame:
    latest = events.groupBy(F.col("shipment_id").alias("id")).agg(F.max("event_time").alias("latest_event_time"))
    return shipments.join(latest, "id", "left")


def latest_port_calls(port_calls: DataFrame) -> DataFrame:
    """Delay and schedule of each route's latest scheduled call (the higher id wins a tie)."""
    call = F.struct("arrival_delay_hours", "scheduled_arrival")
    latest = (
        port_calls.filter("scheduled_arrival IS NOT NULL")
        .groupBy("route_id")
        .agg(F.max_by(call, F.struct("scheduled_arrival", "id")).alias("call"))
    )
    return latest.select(
        "route_id",
        F.col("call.arrival_delay_hours").alias("latest_delay_hours"),
        F.col("call.scheduled_arrival").alias("latest_scheduled_arrival"),
    )


def with_shipment_counts(carriers: DataFrame, shipments: DataFrame) -> DataFrame:
    """Number of distinct shipments per carrier, 0 kept. Shipment ids are unique, so counting rows is counting ids."""
    counts = shipments.groupBy(F.col("carrier_id").alias("id")).agg(F.count("*").alias("shipment_count"))
    return carriers.join(counts, "id", "left").withColumn("shipment_count", F.coalesce("shipment_count", F.lit(0)))


def with_call_counts(ports: DataFrame, port_calls: DataFrame) -> DataFrame:
    counts = port_calls.groupBy(F.col("port_id").alias("id")).agg(F.count("*").alias("port_call_count"))
    return ports.join(counts, "id", "left").withColumn("port_call_count", F.coalesce("port_call_count", F.lit(0)))
