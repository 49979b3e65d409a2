"""Ranking, running and lagging columns over shipments, built on bounded scans (see ``ordering``).

Ties on departure are broken by id where a row order is needed, so results are repeatable.
Narrow the frame to the columns you need first: rows are shuffled once, at full width.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import ratio
from lanewise.operators.ordering import Key, exclusive_scan, positions, previous, with_levels, with_peer_totals

_BY_DEPARTURE = Key("departure_date")


def _value() -> Column:
    return F.coalesce("declared_value", F.lit(Decimal(0)))


def with_running_total_value(df: DataFrame) -> DataFrame:
    """Cumulative value by departure; shipments departing at the same instant share one total."""
    out = with_peer_totals(df, _BY_DEPARTURE, {"_value": F.sum(_value())})
    total = (F.col("before__value") + F.col("_value")).cast("decimal(38,2)")
    return out.withColumn("running_total_value", total).drop("_value", "before__value", "total__value")


def with_moving_avg_value(df: DataFrame, window_days: int | None = None) -> DataFrame:
    """Average value by departure.

    Without ``window_days`` the average is cumulative from the first departure. With it, the average
    covers departures from ``window_days`` days before each one up to and including it.
    """
    measures = {"_value": F.sum(_value()), "_rows": F.count("*")}
    if window_days is None:
        out = with_peer_totals(df, _BY_DEPARTURE, measures)
        total, rows = F.col("before__value") + F.col("_value"), F.col("before__rows") + F.col("_rows")
        return out.withColumn("moving_avg_value", ratio(total, rows, 6)).drop(
            "_value", "_rows", "before__value", "before__rows", "total__value", "total__rows"
        )
    # probe points at (departure - n days) are added to the departures, with nothing to sum there
    shift = window_days * 86_400_000_000
    dated = df.filter("departure_date IS NOT NULL")
    probes = dated.select((F.col("departure_date") - F.make_dt_interval(days=F.lit(window_days))).alias("departure_date")).distinct()
    points = dated.groupBy("departure_date").agg(*[m.alias(n) for n, m in measures.items()]).unionByName(probes, allowMissingColumns=True)
    points = points.groupBy("departure_date").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in measures])
    points, levels = with_levels(points, [_BY_DEPARTURE])
    scanned = exclusive_scan(points, [], levels, sums=list(measures))
    upto = scanned.filter("_rows > 0").select(
        F.col("departure_date"),
        F.col("_k0").alias("_at"),
        (F.col("before__value") + F.col("_value")).alias("_value_to"),
        (F.col("before__rows") + F.col("_rows")).alias("_rows_to"),
    )
    below = scanned.select((F.col("_k0") + shift).alias("_at"), F.col("before__value").alias("_value_from"), F.col("before__rows").alias("_rows_from"))
    averages = upto.join(below, "_at").select(
        "departure_date",
        ratio(F.col("_value_to") - F.col("_value_from"), F.col("_rows_to") - F.col("_rows_from"), 6).alias("moving_avg_value"),
    )
    return df.join(averages, "departure_date", "left")


def with_carrier_rank_by_volume(df: DataFrame) -> DataFrame:
    """Each shipment's carrier's shipment count and the dense rank of that count, largest first."""
    counts = df.groupBy("carrier_id").agg(F.count("*").alias("carrier_shipment_count"))
    ranks = positions(counts.select("carrier_shipment_count").distinct(), [Key("carrier_shipment_count", descending=True, slices=())], into="carrier_volume_rank")
    return df.join(counts.join(ranks, "carrier_shipment_count"), "carrier_id")


def with_row_number_by_carrier(df: DataFrame) -> DataFrame:
    return positions(df, [_BY_DEPARTURE, Key("id")], ["carrier_id"], into="carrier_row_num")


def with_lag_arrival(df: DataFrame) -> DataFrame:
    """Arrival of the carrier's previous departure; NULL for its first, or when that one has not arrived."""
    return previous(df, "actual_arrival", [_BY_DEPARTURE, Key("id")], ["carrier_id"], into="prev_arrival")


def with_percentile_rank_by_weight(df: DataFrame) -> DataFrame:
    """Percent rank by ``total_gross_weight_kg`` (add it with ``with_cargo_summary`` first)."""
    df = df.withColumn("_weight", F.coalesce("total_gross_weight_kg", F.lit(0).cast("decimal(16,3)")))
    out = with_peer_totals(df, Key("_weight"), {"_rows": F.count("*")})
    rank = F.when(F.col("total__rows") > 1, F.col("before__rows") / (F.col("total__rows") - 1)).otherwise(F.lit(0.0))
    return out.withColumn("weight_percentile_rank", rank.cast("double")).drop("_weight", "_rows", "before__rows", "total__rows")


def with_quartile_by_value(df: DataFrame, buckets: int = 4) -> DataFrame:
    """NTILE by value, smallest first, NULL values last. The first rows-mod-buckets buckets hold one row more."""
    out = positions(df, [Key("declared_value"), Key("id")], into="_at", total="_of")
    small = F.floor(F.col("_of") / buckets)
    extra = F.col("_of") % buckets
    edge = extra * (small + 1)
    bucket = F.when(F.col("_at") <= edge, F.ceil(F.col("_at") / (small + 1))).otherwise(extra + F.ceil((F.col("_at") - edge) / small))
    return out.withColumn("value_quartile", bucket.cast("int")).drop("_at", "_of")


def top_per_carrier(df: DataFrame, n: int) -> DataFrame:
    """The first n departures of every carrier."""
    return with_row_number_by_carrier(df).filter(F.col("carrier_row_num") <= n)
