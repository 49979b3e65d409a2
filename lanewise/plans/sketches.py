"""Transit times and customers per carrier and day as stored sketches, merged over any stretch of days.

A day's sketch is a few kilobytes however many deliveries it had, and sketches of a stretch merge into one of the same size, so percentiles of
a year cost its days and not its deliveries. They are approximate: with ``RANK_SIZE`` a percentile's true rank is within 2 % of the rank
asked for (99 % of the time), with ``DISTINCT_BITS`` a number of customers within 5 % (three standard errors). Small days are exact.
:func:`lanewise.plans.reports.transit_percentiles` is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions import columns as C

RANK_SIZE, DISTINCT_BITS = 200, 12


def delivered_days(shipments: DataFrame) -> DataFrame:
    """``carrier_id, day, transit_days, shipper_id`` of every delivery; ``day`` is that of the arrival."""
    done = shipments.filter("status = 'DELIVERED' AND actual_arrival IS NOT NULL AND departure_date IS NOT NULL")
    days = C.elapsed_micros(F.col("actual_arrival"), F.col("departure_date")) / F.lit(86_400_000_000.0)
    return done.select("carrier_id", F.to_date("actual_arrival").alias("day"), days.alias("transit_days"), "shipper_id")


def daily_sketches(shipments: DataFrame) -> DataFrame:
    """``carrier_id, day, deliveries, transit, customers``: a row a carrier and day with deliveries; keep it and add days as they end."""
    return delivered_days(shipments).groupBy("carrier_id", "day").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.kll_sketch_agg_double("transit_days", RANK_SIZE).alias("transit"),
        F.hll_sketch_agg("shipper_id", DISTINCT_BITS).alias("customers"),
    )


def between(sketches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``carrier_id, median_days, p95_days, customers, sample_size`` over the days from ``start`` to ``end``, both included. Carriers without deliveries then have no row."""
    kept = sketches
    for bound, inside in ((start, F.col("day") >= F.to_date(F.lit(start))), (end, F.col("day") <= F.to_date(F.lit(end)))):
        kept = kept if bound is None else kept.filter(inside)
    merged = kept.groupBy("carrier_id").agg(F.kll_merge_agg_double("transit").alias("transit"), F.hll_union_agg("customers").alias("customers"), F.sum("deliveries").alias("sample_size"))
    at = lambda rank: F.kll_sketch_get_quantile_double("transit", F.lit(rank))
    return merged.select("carrier_id", at(0.5).alias("median_days"), at(0.95).alias("p95_days"), F.hll_sketch_estimate("customers").alias("customers"), "sample_size")
