"""Derived columns, all built-in expressions so they stay inside whole-stage codegen."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.functions import domain


def instant(as_of: str | datetime) -> Column:
    """The explicit "now" of a report; reports never read the wall clock."""
    if isinstance(as_of, datetime):
        as_of = as_of.isoformat(sep=" ")
    return F.to_timestamp(F.lit(as_of))


def ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """Exact decimal quotient rounded half up; NULL when the denominator is 0."""
    top = numerator.cast("decimal(28,6)")
    bottom = F.nullif(denominator.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return F.round(top / bottom, scale).cast(f"decimal(28,{scale})")


def percent(part: Column, whole: Column, scale: int = 2) -> Column:
    """100 * part / whole, multiplied before dividing so nothing is truncated."""
    return ratio(part.cast("decimal(18,0)") * F.lit(Decimal(100)), whole, scale)


def label(code: Column | str, labels: dict[str, str]) -> Column:
    """Display label of a code; unknown codes show as themselves."""
    code = F.col(code) if isinstance(code, str) else code
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), code), code)


def past_eta(as_of: str | datetime) -> Column:
    """ETA passed and not finished. A NULL ETA is never late."""
    return (F.col("estimated_arrival") < instant(as_of)) & ~F.col("status").isin(domain.TERMINAL_STATUSES)


def past_eta_in_snapshots(as_of: str | datetime) -> Column:
    """The narrower late rule the metric snapshots store."""
    return (F.col("estimated_arrival") < instant(as_of)) & F.col("status").isin(domain.LATE_IN_SNAPSHOTS)


def is_delayed(as_of: str | datetime) -> Column:
    """0/1 integer, so sums are counts."""
    return F.when(past_eta(as_of), 1).otherwise(0).cast("int")


def is_active() -> Column:
    return F.col("status").isin(domain.ACTIVE_STATUSES)


def is_on_time() -> Column:
    """1 when delivered no later than the ETA, else 0 (undelivered rows count as 0)."""
    on_time = (F.col("actual_arrival") <= F.col("estimated_arrival")) & (F.col("status") == "DELIVERED")
    return F.when(on_time, 1).otherwise(0).cast("int")


def value_tier(value: Column | str = "declared_value") -> Column:
    value = F.col(value) if isinstance(value, str) else value
    tier = None
    for name, floor in domain.VALUE_TIERS:
        reached = value >= F.lit(Decimal(floor))
        tier = F.when(reached, name) if tier is None else tier.when(reached, name)
    return tier.otherwise("standard")


def transit_duration(as_of: str | datetime) -> Column:
    """Day-time interval from departure to arrival, or to as_of while still under way."""
    return F.coalesce(F.col("actual_arrival"), instant(as_of)) - F.col("departure_date")


def elapsed_micros(end: Column, start: Column) -> Column:
    return F.unix_micros(end) - F.unix_micros(start)


def elapsed_seconds(end: Column, start: Column) -> Column:
    """Whole seconds, truncated toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def hours_overdue(as_of: str | datetime) -> Column:
    return F.timestamp_diff("HOUR", F.col("estimated_arrival"), instant(as_of)).cast("long")


def tracking_number(key: Column | str) -> Column:
    """GT- and 8 hex digits, derived from a key so that a re-run gives the same number."""
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("GT-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 8)))


def event_for_status(status: Column | str = "status") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    pairs = [F.lit(x) for pair in domain.EVENT_FOR_STATUS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), status), F.lit("EXCEPTION"))


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def hashed_id(*parts: Column) -> Column:
    """A stable UUID-shaped id for rows a job writes, so a retried job writes the same id."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])
