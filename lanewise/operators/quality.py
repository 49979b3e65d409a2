"""Data-quality rules as batch operators.

``violations`` style operators return one row per (table, key, rule_name). A rule over NULL passes, as
a database CHECK does; only a condition that is false counts. All row rules of a table run in one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import domain
from lanewise.operators.ordering import Key, previous, union_all

# fixed patterns
COUNTRY = "^[A-Z]{2}$"
CURRENCY = "^[A-Z]{3}$"
IMO_NUMBER = "^[0-9]{7}$"
UN_NUMBER = "^[0-9]{4}$"


def _is_in(column: str, values) -> Column:
    return F.col(column).isin(*values)


def _ordered(late: str, early: str, strict: bool = False) -> Column:
    return F.col(late) > F.col(early) if strict else F.col(late) >= F.col(early)


def _blank_or(column: str, pattern: str) -> Column:
    return (F.col(column) == "") | F.rlike(F.col(column), F.lit(pattern))


def _matches(column: str, pattern: str) -> Column:
    return F.rlike(F.col(column), F.lit(pattern))


def row_rules(table: str) -> dict[str, Column]:
    """Rule name -> condition that must not be false, for one table."""
    c = F.col
    rules = {
        "companies": {
            "company_type_valid": lambda: _is_in("company_type", domain.COMPANY_TYPES),
            "country_code_iso2": lambda: _matches("country_code", COUNTRY),
        },
        "ports": {
            "latitude_range": lambda: c("latitude").between(-90, 90),
            "longitude_range": lambda: c("longitude").between(-180, 180),
            "country_code_iso2": lambda: _matches("country_code", COUNTRY),
        },
        "carriers": {
            "mode_valid": lambda: _is_in("mode", domain.CARRIER_MODES),
            "imo_number_format": lambda: _blank_or("imo_number", IMO_NUMBER),
        },
        "routes": {
            "transit_days_min_positive": lambda: c("transit_days_min") > 0,
            "transit_days_max_gte_min": lambda: _ordered("transit_days_max", "transit_days_min"),
            "weekly_frequency_range": lambda: c("weekly_frequency").between(1, 21),
            "effective_dates_ordered": lambda: _ordered("effective_until", "effective_from", strict=True),
        },
        "shipments": {
            "status_valid": lambda: _is_in("status", domain.SHIPMENT_STATUSES),
            "declared_value_non_negative": lambda: c("declared_value") >= 0,
            "freight_cost_non_negative": lambda: c("freight_cost") >= 0,
            "arrival_after_departure": lambda: _ordered("estimated_arrival", "departure_date", strict=True),
            "actual_arrival_after_departure": lambda: _ordered("actual_arrival", "departure_date"),
            "currency_code_iso4217": lambda: _matches("currency_code", CURRENCY),
        },
        "cargo": {
            "gross_weight_positive": lambda: c("gross_weight_kg") > 0,
            "net_weight_positive": lambda: c("net_weight_kg") > 0,
            "net_weight_lte_gross": lambda: c("net_weight_kg") <= c("gross_weight_kg"),
            "volume_positive": lambda: c("volume_cbm") > 0,
            "package_count_positive": lambda: c("package_count") > 0,
            "hazmat_requires_un_number": lambda: ~c("is_hazmat") | (c("un_number") != ""),
            "temperature_range_ordered": lambda: _ordered("temperature_max_c", "temperature_min_c"),
            "un_number_format": lambda: _blank_or("un_number", UN_NUMBER),
        },
        "tracking_events": {
            "event_type_valid": lambda: _is_in("event_type", domain.EVENT_TYPES),
            "resolved_requires_exception": lambda: ~c("exception_resolved") | c("is_exception"),
        },
        "port_calls": {
            "call_sequence_positive": lambda: c("call_sequence") >= 1,
            "scheduled_departure_after_arrival": lambda: _ordered("scheduled_departure", "scheduled_arrival"),
            "actual_departure_after_arrival": lambda: _ordered("actual_departure", "actual_arrival"),
        },
        "analytics_snapshots": {
            "entity_type_valid": lambda: _is_in("entity_type", domain.SNAPSHOT_ENTITIES),
            "granularity_valid": lambda: _is_in("granularity", domain.SNAPSHOT_GRANULARITIES),
        },
    }
    return {name: build() for name, build in rules[table].items()}


def row_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows that break a row rule, from a single scan of the table."""
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in row_rules(table).items()]
    names = F.array_compact(F.array(*broken))
    return df.select(F.lit(table).alias("table"), F.col("id").cast("string").alias("key"), F.explode(names).alias("rule_name"))


# table -> rule name -> (key columns, filter of the rows it covers)
UNIQUE_RULES: dict[str, dict[str, tuple[list[str], str]]] = {
    "companies": {"tax_id_unique": (["tax_id"], "tax_id IS NOT NULL")},
    "ports": {"un_locode_unique": (["un_locode"], "un_locode IS NOT NULL")},
    "carriers": {"carrier_code_unique": (["carrier_code"], "carrier_code IS NOT NULL")},
    "routes": {
        "route_code_unique": (["route_code"], "route_code IS NOT NULL"),
        "active_lane_unique": (["carrier_id", "origin_port_id", "destination_port_id"], "status = 'ACTIVE'"),
    },
    "shipments": {
        "tracking_number_unique": (["tracking_number"], "tracking_number IS NOT NULL"),
        "bill_of_lading_unique": (["bill_of_lading"], "bill_of_lading <> ''"),
    },
    "port_calls": {"route_sequence_unique": (["route_id", "call_sequence"], "true")},
    "analytics_snapshots": {
        "metric_unique": (["entity_type", "entity_id", "metric_key", "snapshot_date", "granularity"], "true"),
    },
}


def unique_violations(df: DataFrame, table: str) -> DataFrame:
    """Keys stored more than once; ``key`` joins the key values with ``|``. Partial counts keep a hot key cheap."""
    found = []
    for rule, (columns, covered) in UNIQUE_RULES.get(table, {}).items():
        repeated = df.filter(covered).groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1")
        key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        found.append(repeated.select(F.lit(table).alias("table"), key.alias("key"), F.lit(rule).alias("rule_name")))
    return union_all(found)


# (table, column, referenced table)
REFERENCES: list[tuple[str, str, str]] = [
    ("carriers", "company_id", "companies"),
    ("routes", "carrier_id", "carriers"),
    ("routes", "origin_port_id", "ports"),
    ("routes", "destination_port_id", "ports"),
    ("shipments", "shipper_id", "companies"),
    ("shipments", "consignee_id", "companies"),
    ("shipments", "notify_party_id", "companies"),
    ("shipments", "carrier_id", "carriers"),
    ("shipments", "route_id", "routes"),
    ("shipments", "origin_port_id", "ports"),
    ("shipments", "destination_port_id", "ports"),
    ("cargo", "shipment_id", "shipments"),
    ("tracking_events", "shipment_id", "shipments"),
    ("tracking_events", "port_id", "ports"),
    ("tracking_events", "supersedes_id", "tracking_events"),
    ("port_calls", "route_id", "routes"),
    ("port_calls", "port_id", "ports"),
]


def reference_violations(tables: dict[str, DataFrame], table: str) -> DataFrame:
    """Rows of ``table`` whose reference points at no row; a NULL reference is allowed."""
    found = []
    for child, column, parent in REFERENCES:
        if child != table:
            continue
        known = tables[parent].select(F.col("id").alias(column))
        rows = tables[child].filter(F.col(column).isNotNull()).select("id", column)
        lost = rows.join(known, column, "left_anti")
        found.append(lost.select(F.lit(child).alias("table"), F.col("id").cast("string").alias("key"), F.lit(f"{column}_exists").alias("rule_name")))
    return union_all(found)


def move_allowed(before: Column, after: Column) -> Column:
    """Is a status change legal? Staying is; a NULL ``before`` (first status) is."""
    moves = F.create_map(*[x for s, to in domain.STATUS_MOVES.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in to]).cast("array<string>"))])
    return before.isNull() | (before == after) | F.coalesce(F.array_contains(F.element_at(moves, before), after), F.lit(False))


def illegal_moves(changes: DataFrame) -> DataFrame:
    """Pairs of consecutive statuses in a change log (id, shipment_id, changed_at, status) that the status
    machine forbids. ``terminal`` tells those leaving a terminal status."""
    paired = previous(changes, "status", [Key("changed_at"), Key("id")], ["shipment_id"], into="from_status")
    bad = paired.filter(~move_allowed(F.col("from_status"), F.col("status")))
    return bad.select("shipment_id", "id", "changed_at", "from_status", F.col("status").alias("to_status"), F.col("from_status").isin(*domain.TERMINAL_STATUSES).alias("terminal"))


def _first_failure(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that fails (its condition is true), else NULL."""
    chain = None
    for name, failed in rules:
        failed = F.coalesce(failed, F.lit(False))
        chain = F.when(failed, name) if chain is None else chain.when(failed, name)
    return chain


def check_bookings(bookings: DataFrame, carriers: DataFrame, routes: DataFrame, as_of_column: Column) -> DataFrame:
    """Bookings with ``error``: the first rule each breaks, or NULL. Field rules come first, then carrier,
    route, ports and ETA. The currency defaults to USD and is upper-cased."""
    c = F.col
    known = carriers.select(c("id").alias("carrier_id"), c("is_active").alias("_carrier_active"))
    lanes = routes.select(
        c("id").alias("route_id"),
        c("carrier_id").alias("_route_carrier"),
        c("status").alias("_route_status"),
        c("origin_port_id").alias("_route_origin"),
        c("destination_port_id").alias("_route_destination"),
    )
    currency = F.coalesce("currency_code", F.lit("USD"))
    error = _first_failure(
        ("departure_in_past", c("departure_date") <= as_of_column),
        ("declared_value_negative", c("declared_value") < 0),
        ("freight_cost_negative", c("freight_cost") < 0),
        ("currency_not_3_letters", ~F.rlike(currency, F.lit(r"^\p{L}{3}$"))),
        ("carrier_missing", c("_carrier_active").isNull()),
        ("carrier_inactive", ~c("_carrier_active")),
        ("route_missing", c("_route_carrier").isNull()),
        ("route_of_other_carrier", c("_route_carrier") != c("carrier_id")),
        ("route_not_bookable", ~c("_route_status").isin(*domain.BOOKABLE_ROUTE_STATUSES)),
        ("origin_not_on_route", c("_route_origin") != c("origin_port_id")),
        ("destination_not_on_route", c("_route_destination") != c("destination_port_id")),
        ("arrival_not_after_departure", c("estimated_arrival") <= c("departure_date")),
    )
    joined = bookings.join(known, "carrier_id", "left").join(lanes, "route_id", "left")
    return joined.select(*[F.upper(currency).alias(n) if n == "currency_code" else c(n) for n in bookings.columns], error.alias("error"))


def check_cargo(cargo: DataFrame) -> DataFrame:
    """Cargo submissions with ``error``: the first rule each breaks, or NULL."""
    c = F.col
    un_number = F.coalesce("un_number", F.lit(""))
    return cargo.withColumn(
        "error",
        _first_failure(
            ("gross_weight_not_positive", c("gross_weight_kg") <= 0),
            ("un_number_not_4_digits", (un_number != "") & ~F.rlike(un_number, F.lit(UN_NUMBER))),
            ("net_weight_above_gross", c("net_weight_kg") > c("gross_weight_kg")),
            ("hazmat_without_un_number", c("is_hazmat") & (un_number == "")),
            ("reefer_without_temperature", (c("cargo_type") == "REEFER") & c("temperature_min_c").isNull()),
            ("temperature_range_reversed", c("temperature_max_c") < c("temperature_min_c")),
        ),
    )


def check_events(events: DataFrame, shipments: DataFrame, as_of_column: Column) -> DataFrame:
    """Event submissions (with ``exception_description``) against their shipment's status.

    ``error`` is the first rule each breaks, or NULL; ``description`` gets the exception text in front.
    """
    c = F.col
    allowed = F.create_map(*[x for s, types in domain.EVENTS_ALLOWED.items() for x in (F.lit(s), F.array(*[F.lit(t) for t in types]).cast("array<string>"))])
    status = shipments.select(c("id").alias("shipment_id"), c("status").alias("_status"))
    exception = F.coalesce("exception_description", F.lit(""))
    existing = F.coalesce("description", F.lit(""))
    merged = F.when(exception == "", existing).otherwise(
        F.concat(F.lit("[EXCEPTION] "), exception, F.when(existing == "", "").otherwise(F.concat(F.lit("\n"), existing)))
    )
    error = _first_failure(
        ("shipment_missing", c("_status").isNull()),
        ("shipment_closed", c("_status").isin(*domain.TERMINAL_STATUSES)),
        ("event_in_future", c("event_time") > as_of_column),
        ("event_type_not_allowed", ~F.array_contains(F.element_at(allowed, c("_status")), c("event_type"))),
        ("exception_without_description", c("is_exception") & (exception == "")),
    )
    joined = events.join(status, "shipment_id", "left")
    kept = [merged.alias(n) if n == "description" else c(n) for n in events.columns if n != "exception_description"]
    return joined.select(*kept, error.alias("error"))
