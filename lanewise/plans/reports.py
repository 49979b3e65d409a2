"""Operational reports. ``*_corrected`` stands beside a report whose published arithmetic double counts.

A report that must reproduce "one row per cargo line" or "one row per event" weights weighs each
shipment by its child count; the joined rows themselves are never produced.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewise.functions import columns as C
from lanewise.operators import filters, joins
from lanewise.operators.intervals import running_counts
from lanewise.operators.ordering import Key, exclusive_scan, positions, with_levels
from lanewise.sources.checkpoints import materialized


def _money(total: Column, digits: int = 22) -> Column:
    return F.coalesce(total.cast(f"decimal({digits},2)"), F.lit(Decimal(0)).cast(f"decimal({digits},2)"))


def _weight(total: Column) -> Column:
    return F.coalesce(total.cast("decimal(18,3)"), F.lit(Decimal(0)).cast("decimal(18,3)"))


def dashboard_summary(shipments: DataFrame, as_of: str) -> DataFrame:
    """One row: total, active, delayed and total declared value, in one pass."""
    return shipments.agg(
        F.count("*").alias("total"),
        F.count_if(C.is_active()).alias("active"),
        F.count_if(C.past_eta(as_of)).alias("delayed"),
        _money(F.sum("declared_value")).alias("total_declared_value"),
    )


def _carrier_totals(shipments: DataFrame, cargo: DataFrame, carriers: DataFrame, as_of: str, weight: Column) -> DataFrame:
    """Per carrier sums where each shipment counts ``weight`` times."""
    totals = joins.cargo_totals(cargo).withColumnRenamed("shipment_id", "id")
    rows = shipments.join(totals, "id", "left").withColumns({"_times": weight, "_late": C.is_delayed(as_of)})
    grouped = rows.groupBy("carrier_id").agg(
        F.sum("_times").alias("shipment_count"),
        F.sum(F.col("_late") * F.col("_times")).alias("_delayed"),
        F.sum(F.col("declared_value") * F.col("_times").cast("decimal(10,0)")).alias("_value"),
        F.sum(F.when(F.col("declared_value").isNotNull(), F.col("_times"))).alias("_valued"),
        _weight(F.sum("total_gross_weight_kg")).alias("total_gross_weight_kg"),
    )
    return grouped.join(carriers.select(F.col("id").alias("carrier_id"), "carrier_name"), "carrier_id")


def _performance(totals: DataFrame, rate: Column) -> DataFrame:
    return totals.select(
        "carrier_id",
        "carrier_name",
        "shipment_count",
        rate.cast("decimal(6,2)").alias("delay_rate_pct"),
        F.coalesce(C.ratio(F.col("_value"), F.col("_valued"), 2), F.lit(Decimal("0.00"))).cast("decimal(18,2)").alias("avg_declared_value"),
        "total_gross_weight_kg",
    )


def carrier_performance_summary(shipments: DataFrame, cargo: DataFrame, carriers: DataFrame, as_of: str) -> DataFrame:
    """As published: every measure is weighted by the shipment's cargo lines (none counts once) and
    the delay rate is an integer quotient, so it is 0 or 100."""
    totals = _carrier_totals(shipments, cargo, carriers, as_of, F.greatest(F.coalesce("cargo_rows", F.lit(1)), F.lit(1)))
    return _performance(totals, F.expr("(_delayed div shipment_count) * 100"))


def carrier_performance_summary_corrected(shipments: DataFrame, cargo: DataFrame, carriers: DataFrame, as_of: str) -> DataFrame:
    """Each shipment counts once and the delay rate is a true percentage."""
    totals = _carrier_totals(shipments, cargo, carriers, as_of, F.lit(1).cast("long"))
    return _performance(totals, C.percent(F.col("_delayed"), F.col("shipment_count")))


def ranked(report: DataFrame) -> DataFrame:
    """Leaderboard position: 1..n by shipment count, ties by carrier."""
    return positions(report, [Key("shipment_count", descending=True, slices=()), Key("carrier_id")], into="volume_rank")


def carrier_leaderboard(shipments: DataFrame, cargo: DataFrame, carriers: DataFrame, as_of: str) -> DataFrame:
    return ranked(carrier_performance_summary(shipments, cargo, carriers, as_of))


def carrier_leaderboard_corrected(shipments: DataFrame, cargo: DataFrame, carriers: DataFrame, as_of: str) -> DataFrame:
    return ranked(carrier_performance_summary_corrected(shipments, cargo, carriers, as_of))


def monthly_volume_trend(shipments: DataFrame) -> DataFrame:
    """Shipments and value per departure month, oldest first."""
    months = shipments.filter("departure_date IS NOT NULL").groupBy(C.month_start(F.to_date("departure_date")).alias("month"))
    return months.agg(F.count("*").alias("shipment_count"), _money(F.sum("declared_value"), 20).alias("total_declared_value")).orderBy("month")


def recent_volume_trend(shipments: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    return monthly_volume_trend(filters.trend_window(shipments, as_of, months))


def recent_volume_trend_corrected(shipments: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Calendar months instead of spans of 30 days."""
    return monthly_volume_trend(filters.trend_window_corrected(shipments, as_of, months))


def route_utilization(shipments: DataFrame, routes: DataFrame, as_of: str) -> DataFrame:
    """Per route: shipments, mean transit time (0 when none arrived) and delays."""
    transit = C.elapsed_micros(F.col("actual_arrival"), F.col("departure_date"))
    grouped = shipments.groupBy("route_id").agg(
        F.count("*").alias("shipment_count"),
        F.sum(transit.cast("decimal(38,0)")).alias("_micros"),
        F.count(transit).alias("_arrived"),
        F.sum(C.is_delayed(as_of)).alias("delay_count"),
    )
    seconds = C.ratio(F.col("_micros") / F.lit(1_000_000).cast("decimal(8,0)"), F.col("_arrived"), 6)
    return grouped.join(routes.select(F.col("id").alias("route_id"), "route_code"), "route_id").select(
        "route_id",
        "route_code",
        "shipment_count",
        F.make_dt_interval(secs=F.coalesce(seconds, F.lit(Decimal(0))).cast("decimal(18,6)")).alias("avg_transit_days"),
        "delay_count",
    )


def top_routes(shipments: DataFrame, routes: DataFrame, as_of: str, limit: int = 10) -> DataFrame:
    """The busiest routes of the last 90 days, ties by route."""
    recent = filters.departed_since(shipments, as_of, 90)
    return route_utilization(recent, routes, as_of).orderBy(F.desc("shipment_count"), "route_id").limit(limit)


def on_time_rate(shipments: DataFrame, *by: str) -> DataFrame:
    """Percentage delivered by the ETA; every row is in the denominator, delivered or not."""
    grouped = shipments.groupBy(*by).agg(F.sum(C.is_on_time()).alias("_good"), F.count("*").alias("_all"))
    return grouped.select(*by, C.percent(F.col("_good"), F.col("_all")).cast("decimal(5,2)").alias("on_time_rate"))


def exception_rate_by_carrier(events: DataFrame, shipments: DataFrame, carriers: DataFrame) -> DataFrame:
    """Events and exceptions per carrier, highest rate first. Events are totalled per shipment before the join."""
    totals = joins.event_totals(events).select("shipment_id", "event_rows", "exception_rows")
    owned = totals.join(shipments.select(F.col("id").alias("shipment_id"), "carrier_id"), "shipment_id")
    grouped = owned.groupBy("carrier_id").agg(F.sum("event_rows").alias("total_events"), F.sum("exception_rows").alias("exception_count"))
    rate = C.percent(F.col("exception_count"), F.col("total_events")).cast("decimal(6,2)")
    return (
        grouped.join(carriers.select(F.col("id").alias("carrier_id"), "carrier_name"), "carrier_id")
        .select("carrier_id", "carrier_name", "total_events", "exception_count", rate.alias("exception_rate_pct"))
        .orderBy(F.desc("exception_rate_pct"), "carrier_id")
    )


def active_by_mode(carriers: DataFrame, companies: DataFrame, shipments: DataFrame, mode: str) -> DataFrame:
    """Active carriers of a mode with their company and shipment count, busiest first."""
    chosen = joins.with_company(filters.by_mode(filters.active_carriers(carriers), mode), companies)
    return joins.with_shipment_counts(chosen, shipments).orderBy(F.desc("shipment_count"), "id")


def hub_coverage(carriers: DataFrame, companies: DataFrame, shipments: DataFrame, un_locode: str) -> DataFrame:
    """Active carriers that hub through a port."""
    chosen = joins.with_company(filters.hubbing_through(filters.active_carriers(carriers), un_locode), companies)
    return joins.with_shipment_counts(chosen, shipments)


def transit_percentiles(shipments: DataFrame, *carrier_ids) -> DataFrame:
    """Exact median and 95th percentile of delivered transit days per carrier, and the sample size.

    Linear interpolation between neighbours. Equal durations are counted first and located by a bounded
    scan, so one carrier with a third of the fleet does not gather its durations in one task. A
    percentile of exactly 0 days shows as NULL, as the published report does. Carriers asked for by id always have a row, without
    deliveries one of NULL, NULL and 0.
    """
    return _transit_percentiles(shipments, carrier_ids, zero_is_null=True)


def transit_percentiles_corrected(shipments: DataFrame, *carrier_ids) -> DataFrame:
    """The same with a percentile of exactly 0 days as 0."""
    return _transit_percentiles(shipments, carrier_ids, zero_is_null=False)


def _transit_percentiles(shipments: DataFrame, carrier_ids: tuple, zero_is_null: bool) -> DataFrame:
    done = shipments.filter("status = 'DELIVERED' AND actual_arrival IS NOT NULL AND departure_date IS NOT NULL")
    if carrier_ids:
        done = done.filter(F.col("carrier_id").isin(*carrier_ids))
    timed = done.select("carrier_id", C.elapsed_micros(F.col("actual_arrival"), F.col("departure_date")).alias("_micros"))
    found = _percentiles(timed, "carrier_id", "_micros", {"median_days": 0.5, "p95_days": 0.95}, zero_is_null)
    if not carrier_ids:
        return found
    named = shipments.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(carrier_ids)], StructType([shipments.schema["carrier_id"]]))
    return named.join(found, "carrier_id", "left").withColumn("sample_size", F.coalesce("sample_size", F.lit(0)))


def _percentiles(df: DataFrame, group: str, micros: str, wanted: dict[str, float], zero_is_null: bool) -> DataFrame:
    rows, levels = with_levels(df, [Key(micros, slices=(26,))])
    cells = rows.groupBy(group, *levels).agg(F.count("*").alias("_n"))
    cells = exclusive_scan(cells, [group], levels, sums=["_n"], totals=["_n"])
    picks = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("total__n") - 1)
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            here = (F.col("before__n") <= place) & (place < F.col("before__n") + F.col("_n"))
            picks.append(F.max(F.when(here, F.col(levels[-1]))).alias(f"_{name}_{end}"))
    picked = cells.groupBy(group).agg(F.first("total__n").alias("sample_size"), *picks)
    out = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("sample_size") - 1)
        lo, hi = F.col(f"_{name}_lo") / F.lit(86_400_000_000.0), F.col(f"_{name}_hi") / F.lit(86_400_000_000.0)
        between = lo + (hi - lo) * (at - F.floor(at))
        out.append((F.nullif(between, F.lit(0.0)) if zero_is_null else between).alias(name))
    return picked.select(group, *out, "sample_size")


def transit_percentiles_approx(shipments: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """The same percentiles from a bounded-size sketch: cheaper, and not exact."""
    days = C.elapsed_micros(F.col("actual_arrival"), F.col("departure_date")) / F.lit(86_400_000_000.0)
    done = shipments.filter("status = 'DELIVERED' AND actual_arrival IS NOT NULL AND departure_date IS NOT NULL")
    found = done.groupBy("carrier_id").agg(
        F.percentile_approx(days, F.array(F.lit(0.5), F.lit(0.95)), accuracy).alias("_p"), F.count("*").alias("sample_size")
    )
    return found.select("carrier_id", F.col("_p")[0].alias("median_days"), F.col("_p")[1].alias("p95_days"), "sample_size")


def top_lanes_by_volume(shipments: DataFrame, routes: DataFrame, port_calls: DataFrame, as_of: str, limit: int = 10, days: int = 90) -> DataFrame:
    """The busiest lanes of the last ``days`` days with their latest port call.

    Lanes are totalled and cut to ``limit`` first (at most 100 rows); only then are route codes and port calls looked up.
    """
    filters.check_range("days", days, 1, 365)
    filters.check_range("limit", limit, 1, 100)
    recent = filters.departed_since(shipments, as_of, days)
    lanes = recent.groupBy("route_id").agg(F.count("*").alias("shipment_count"), F.sum("declared_value").cast("decimal(22,2)").alias("total_value"))
    known = lanes.join(routes.select(F.col("id").alias("route_id"), "route_code"), "route_id")
    top = known.orderBy(F.desc("shipment_count"), "route_id").limit(limit)
    return top.join(joins.latest_port_calls(port_calls), "route_id", "left").orderBy(F.desc("shipment_count"), "route_id")


def exception_cascades(events: DataFrame, shipments: DataFrame, as_of: str, days: int = 30, hours: int = 48, limit: int = 100) -> DataFrame:
    """Shipments whose exceptions were followed, within ``hours`` on the same route, by at least two
    exceptions of other shipments; the ``limit`` largest, ties by shipment."""
    filters.check_range("days", days, 1, 365)
    found = cascades(events, shipments, as_of, days, hours).filter("cascade_exception_count >= 2")
    top = found.orderBy(F.desc("cascade_exception_count"), "shipment_id").limit(limit)
    side = shipments.select(F.col("id").alias("shipment_id"), "tracking_number")
    return top.join(side, "shipment_id").select(
        "shipment_id", "tracking_number", "route_id", "cascade_exception_count", "first_exception_time", "last_cascade_time"
    )


def cascades(events: DataFrame, shipments: DataFrame, as_of: str | None, days: int, hours: int) -> DataFrame:
    """:func:`cascade_sources` totalled per shipment: pairs, the first own exception with one, the last of the others."""
    return cascade_totals(cascade_sources(events, shipments, as_of, days, hours))


def cascade_totals(sources: DataFrame) -> DataFrame:
    return sources.groupBy("shipment_id", "route_id").agg(
        F.sum("pairs").alias("cascade_exception_count"),
        F.timestamp_micros(F.min("at")).alias("first_exception_time"),
        F.timestamp_micros(F.max("seen")).alias("last_cascade_time"),
    )


def cascade_sources(events: DataFrame, shipments: DataFrame, as_of: str | None, days: int, hours: int) -> DataFrame:
    """Per shipment and instant ``at`` of own exceptions (of the last ``days`` days, or of any time without ``as_of``): how many
    (own exception, later exception of another shipment) pairs fall in the window, and the last of the others (``seen``).
    Instants without a pair have no row. Times are microseconds.

    No pair is built. Later exceptions on a route are a difference of two running counts; those of the
    shipment itself are a difference of two more. For the last exception of *another* shipment, each instant
    of a route remembers whether one shipment alone had exceptions then, and where the run of that shipment
    was last broken. The exceptions, a small share of the log, are checkpointed because the counts read
    them several times.
    """
    window = hours * 3_600_000_000
    lanes = shipments.select(F.col("id").alias("shipment_id"), "route_id")
    failed = events.filter("is_exception AND event_time IS NOT NULL").groupBy("shipment_id", F.unix_micros("event_time").alias("at"))
    cells = materialized(failed.agg(F.count("*").alias("n")).join(lanes, "shipment_id"))
    sources = cells
    if as_of is not None:
        sources = cells.filter(F.col("at") >= F.unix_micros(C.instant(as_of)) - F.lit(days * 86_400_000_000))
    sources = sources.withColumn("end", F.col("at") + window)

    alone = F.when(F.min("shipment_id") == F.max("shipment_id"), F.max("shipment_id"))
    instants = cells.groupBy("route_id", "at").agg(F.sum("n").alias("n"), alone.alias("alone"))
    instants = instants.withColumn("here", F.struct("alone", "at"))
    probes = sources.select("route_id", F.col("end").alias("at")).distinct()
    seen = running_counts(instants, [probes], ["route_id"], ["n"], ["here"])
    same_run = F.col("before_here.alone").eqNullSafe(F.col("upto_here.alone")) & F.col("upto_here.alone").isNotNull()
    is_event = F.col("upto_here.at") == F.col("at")
    broken = F.when(is_event & ~same_run, F.struct(F.col("before_here.at").alias("at")))
    seen = materialized(seen.withColumn("broken", broken).drop("before_here"))
    turned, levels = with_levels(seen, [Key("at", slices=(26,))])
    turned = exclusive_scan(turned, ["route_id"], levels, lasts=["broken"])
    route = turned.select(
        "route_id", "at", "upto_n", F.col("upto_here.alone").alias("alone"), F.col("upto_here.at").alias("last"), F.coalesce("broken", "before_broken")["at"].alias("other")
    )
    own = running_counts(cells, [sources.select("shipment_id", F.col("end").alias("at"))], ["shipment_id"], ["n"])

    at_start = seen.select("route_id", "at", F.col("upto_n").alias("route_from"))
    at_end = route.select("route_id", F.col("at").alias("end"), F.col("upto_n").alias("route_to"), "alone", "last", "other")
    own_start = own.select("shipment_id", "at", F.col("upto_n").alias("own_from"))
    own_end = own.select("shipment_id", F.col("at").alias("end"), F.col("upto_n").alias("own_to"))
    probed = (
        sources.join(at_start, ["route_id", "at"])
        .join(at_end, ["route_id", "end"])
        .join(own_start, ["shipment_id", "at"])
        .join(own_end, ["shipment_id", "end"])
    )
    others = (F.col("route_to") - F.col("route_from")) - (F.col("own_to") - F.col("own_from"))
    seen_last = F.when(F.col("alone") == F.col("shipment_id"), F.col("other")).otherwise(F.col("last"))
    found = probed.withColumns({"others": others, "seen": seen_last}).filter("others > 0")
    return found.select("shipment_id", "route_id", "at", (F.col("n") * F.col("others")).alias("pairs"), "seen")


def read_carrier_stats(stats: DataFrame, carrier_id, start: str, end: str) -> DataFrame:
    """Rounded daily figures of one carrier from the carrier daily view."""
    days = stats.filter((F.col("carrier_id") == F.lit(carrier_id)) & F.col("stat_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return days.select(
        "carrier_id",
        "stat_date",
        "shipment_count",
        "delay_count",
        F.round("avg_declared_value", 2).alias("avg_declared_value"),
        F.round("total_weight_kg", 3).alias("total_weight_kg"),
        "exception_count",
        C.percent(F.col("delay_count"), F.col("shipment_count")).alias("delay_rate_pct"),
    ).orderBy("stat_date")


def read_port_congestion(congestion: DataFrame, as_of: str, port_id=None, weeks: int = 4, worst: int = 20) -> DataFrame:
    """The last weeks of one port, newest first; or the ``worst`` delays over all ports."""
    since = F.to_date(F.date_trunc("week", C.instant(as_of) - F.make_dt_interval(days=F.lit(7 * weeks))))
    recent = congestion.filter(F.col("stat_week") >= since)
    shown = recent.select(
        "port_id",
        "stat_week",
        "arrival_count",
        F.round("avg_delay_hours", 2).alias("avg_delay_hours"),
        F.round("exception_rate_pct", 2).alias("exception_rate_pct"),
    )
    if port_id is not None:
        return shown.filter(F.col("port_id") == F.lit(port_id)).orderBy(F.desc("stat_week"))
    return shown.orderBy(F.desc_nulls_last("avg_delay_hours"), "port_id", "stat_week").limit(worst)
