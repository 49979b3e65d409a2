"""Row filters. Each is ``op(df, ...) -> df`` for use with ``DataFrame.transform``; all reach the scan."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import columns as C


# shipments


def active(df: DataFrame) -> DataFrame:
    return df.filter(C.is_active())


def delayed(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(C.past_eta(as_of))


def high_value(df: DataFrame, threshold: Decimal) -> DataFrame:
    if not isinstance(threshold, Decimal):
        raise TypeError(f"threshold must be Decimal, got {type(threshold).__name__}")
    return df.filter(F.col("declared_value") >= F.lit(threshold))


def by_carrier(df: DataFrame, carrier_id) -> DataFrame:
    return df.filter(F.col("carrier_id") == F.lit(carrier_id))


def in_date_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Departure between two instants, both included."""
    return df.filter(F.col("departure_date").between(C.instant(start), C.instant(end)))


def departed_since(df: DataFrame, as_of: str, days: int) -> DataFrame:
    cutoff = C.instant(as_of) - F.make_dt_interval(days=F.lit(days))
    return df.filter(F.col("departure_date") >= cutoff)


def trend_window(df: DataFrame, as_of: str, months: int) -> DataFrame:
    """The last ``months`` months, each counted as 30 days, so the first bucket may be partial."""
    check_range("months", months, 1, 24)
    return departed_since(df, as_of, months * 30)


def trend_window_corrected(df: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Departures from the first day of the month ``months`` calendar months before, so that no month shown is partial at its start."""
    check_range("months", months, 1, 24)
    since = F.add_months(F.trunc(C.instant(as_of).cast("date"), "month"), -months)
    return df.filter(F.col("departure_date") >= since.cast("timestamp"))


def check_range(name: str, value: int, low: int, high: int) -> None:
    if not isinstance(value, int) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must be an integer from {low} to {high}, got {value!r}")


def tagged(df: DataFrame, *tags: str, column: str = "tags") -> DataFrame:
    """Rows whose array column contains every given value."""
    return df.filter(contains_all(column, *tags))


def contains_all(column: str, *values: str) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(column, v) for v in values])


def json_contains(df: DataFrame, column: str, **wanted: str) -> DataFrame:
    """Rows whose JSON object in ``column`` has all the given top-level keys with these values."""
    return df.filter(reduce(lambda a, b: a & b, [F.get_json_object(column, f"$['{k}']") == F.lit(v) for k, v in wanted.items()]))


def with_hs_codes(df: DataFrame, *codes: str) -> DataFrame:
    """Shipments that carry goods of every given HS code."""
    return df.filter(contains_all("hs_codes", *codes))


def json_equals(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    return df.filter(F.get_json_object(column, f"$.{key}") == F.lit(value))


def json_has(df: DataFrame, column: str, key: str) -> DataFrame:
    """Rows whose JSON object has the key, also when its value is null."""
    return df.filter(F.array_contains(F.json_object_keys(column), key))


@dataclass(frozen=True)
class ShipmentCriteria:
    """Optional list filters; those given are combined with AND."""

    statuses: tuple[str, ...] = ()
    carrier_id: object = None
    departure_after: str | None = None
    departure_before: str | None = None
    departure_through: str | None = None
    min_value: Decimal | None = None
    max_value: Decimal | None = None
    is_delayed: bool | None = None


def matching(df: DataFrame, criteria: ShipmentCriteria, as_of: str, carriers: DataFrame | None = None) -> DataFrame:
    """Apply the criteria. Dates are midnight instants, so later departures on the
    ``departure_before`` day are out; ``departure_through`` takes the whole day. A carrier must exist and be active to match."""
    c = criteria
    tests: list[Column] = []
    if c.statuses:
        tests.append(F.col("status").isin(*c.statuses))
    if c.departure_after is not None:
        tests.append(F.col("departure_date") >= C.instant(c.departure_after))
    if c.departure_before is not None:
        tests.append(F.col("departure_date") <= C.instant(c.departure_before))
    if c.departure_through is not None:
        tests.append(F.col("departure_date") < C.instant(c.departure_through) + F.make_dt_interval(days=F.lit(1)))
    if c.min_value is not None:
        tests.append(F.col("declared_value") >= F.lit(c.min_value))
    if c.max_value is not None:
        tests.append(F.col("declared_value") <= F.lit(c.max_value))
    if c.is_delayed is not None:
        tests.append(C.is_delayed(as_of) == F.lit(int(c.is_delayed)))
    if tests:
        df = df.filter(reduce(lambda a, b: a & b, tests))
    if c.carrier_id is not None:
        df = by_carrier(df, c.carrier_id)
        if carriers is not None:
            allowed = active_carriers(carriers).filter(F.col("id") == F.lit(c.carrier_id))
            df = df.join(allowed.select(F.col("id").alias("carrier_id")), "carrier_id", "left_semi")
    return df


@dataclass(frozen=True)
class Principal:
    """Who asks: staff, a company's user, a carrier's user, or nobody."""

    is_staff: bool = False
    company_id: object = None
    carrier_id: object = None


def visible_to_company(df: DataFrame, who: Principal) -> DataFrame:
    """Shipments the principal's company ships or receives; staff see all, no company sees none."""
    if who.is_staff:
        return df
    if who.company_id is None:
        return df.filter(F.lit(False))
    company = F.lit(who.company_id)
    return df.filter((F.col("shipper_id") == company) | (F.col("consignee_id") == company))


def visible_to_carrier(df: DataFrame, who: Principal) -> DataFrame:
    if who.is_staff:
        return df
    if who.carrier_id is None:
        return df.filter(F.lit(False))
    return by_carrier(df, who.carrier_id)


# tracking events


def for_shipment(df: DataFrame, shipment_id) -> DataFrame:
    return df.filter(F.col("shipment_id") == F.lit(shipment_id)).orderBy("event_time", "id")


def unresolved_exceptions(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_exception") & ~F.col("exception_resolved"))


def in_time_range(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col("event_time").between(C.instant(start), C.instant(end)))


def not_superseded(events: DataFrame) -> DataFrame:
    """Current facts: events that no later event corrects."""
    corrected = events.filter("supersedes_id IS NOT NULL").select(F.col("supersedes_id").alias("id"))
    return events.join(corrected, "id", "left_anti")


# carriers


def active_carriers(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_active"))


def by_mode(df: DataFrame, mode: str) -> DataFrame:
    return df.filter(F.col("mode") == mode)


def hubbing_through(df: DataFrame, *locodes: str) -> DataFrame:
    return df.filter(contains_all("hub_ports", *locodes))


# ports


def active_ports(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_active"))


def by_type(df: DataFrame, port_type: str) -> DataFrame:
    return df.filter(F.col("port_type") == port_type)


def by_country(df: DataFrame, country_code: str) -> DataFrame:
    return df.filter(F.col("country_code") == country_code)


def lookup_by_locode(df: DataFrame, un_locode: str) -> DataFrame:
    return df.filter(F.col("un_locode") == un_locode)


# lookups the tables are laid out for


def by_tracking_numbers(df: DataFrame, *numbers: str) -> DataFrame:
    return df.filter(F.col("tracking_number").isin(*numbers))


def by_bill_of_lading(df: DataFrame, number: str) -> DataFrame:
    return df.filter(F.col("bill_of_lading") == number)


def by_container(cargo: DataFrame, *numbers: str) -> DataFrame:
    return cargo.filter(F.col("container_number").isin(*numbers))


def by_voyage(port_calls: DataFrame, vessel: str, voyage: str) -> DataFrame:
    return port_calls.filter((F.col("vessel_name") == vessel) & (F.col("voyage_number") == voyage))


def calls_later_than(port_calls: DataFrame, hours: Decimal) -> DataFrame:
    return port_calls.filter(F.col("arrival_delay_hours") > F.lit(hours))


def hazmat_in_transit(cargo: DataFrame, shipments: DataFrame) -> DataFrame:
    moving = shipments.filter("status = 'IN_TRANSIT'").select(F.col("id").alias("shipment_id"))
    return cargo.filter("is_hazmat").join(moving, "shipment_id", "left_semi")


def reefer_below(cargo: DataFrame, celsius: Decimal) -> DataFrame:
    return cargo.filter((F.col("cargo_type") == "REEFER") & (F.col("temperature_min_c") < F.lit(celsius)))


def on_lane(df: DataFrame, origin_port_id, destination_port_id) -> DataFrame:
    """Shipments or routes from one port to another."""
    return df.filter((F.col("origin_port_id") == F.lit(origin_port_id)) & (F.col("destination_port_id") == F.lit(destination_port_id)))


def routes_valid_on(routes: DataFrame, day: str) -> DataFrame:
    day_ = F.to_date(F.lit(day))
    return routes.filter((F.col("effective_from") <= day_) & (F.col("effective_until").isNull() | (F.col("effective_until") >= day_)))


def name_like(df: DataFrame, column: str, part: str) -> DataFrame:
    """Case-insensitive substring search."""
    return df.filter(F.contains(F.lower(column), F.lit(part.lower())))
