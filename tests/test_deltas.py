"""Views kept by changes against views built anew."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lanewise.plans import matviews
from lanewise.sources.bindings import Bindings
from lanewise.sources.checkpoints import materialized

DIRECTORY = "/root/testdata/sf0.001"
AS_OF = "1998-06-01 00:00:00"


@pytest.fixture(scope="module")
def given(spark):
    return Bindings(spark, DIRECTORY)


def drawn(seed, *columns):
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(10))


def changed(shipments, seed):
    """A third of the rows changed, moved or deleted, and some new ones: (old versions, new versions)."""
    draw = drawn(seed, F.col("id"))
    was = shipments.filter(draw < 3)
    now = was.filter(draw > 0).withColumns(
        {
            "carrier_id": F.when(draw == 1, F.col("carrier_id") + 1).otherwise(F.col("carrier_id")),
            "declared_value": F.when(drawn(seed + 1, F.col("id")) < 3, F.lit(None)).otherwise(F.col("declared_value") * 3).cast("decimal(18,2)"),
            "departure_date": F.when(draw == 2, F.col("departure_date") + F.expr("interval 9 days")).otherwise(F.col("departure_date")),
            "status": F.when(draw == 2, "DELIVERED").otherwise(F.col("status")),
        }
    )
    new = shipments.filter(draw == 9).withColumn("id", F.col("id") + 10_000_000)
    return was, now.unionByName(new)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("corrected", [False, True])
def test_carrier_days_and_route_months(spark, given, corrected):
    day = lambda s: matviews.carrier_daily_parts(s, given.cargo, given.tracking_events, AS_OF, corrected)
    shipments = given.shipments
    kept, months = day(shipments), matviews.route_monthly_parts(shipments)
    for seed in (1, 2):
        was, now = changed(shipments, seed)
        kept = materialized(matviews.with_changes(kept, day(was), day(now), matviews.KEYS["mv_carrier_daily_stats"]))
        months = materialized(matviews.with_changes(months, matviews.route_monthly_parts(was), matviews.route_monthly_parts(now), matviews.KEYS["mv_route_monthly_performance"]))
        shipments = materialized(shipments.join(was.select("id"), "id", "left_anti").select(*shipments.columns).unionByName(now))
        assert rows(matviews.carrier_daily_finish(kept)) == rows(matviews.carrier_daily_finish(day(shipments)))
        assert rows(matviews.route_monthly_finish(months)) == rows(matviews.route_monthly_performance(shipments))
    assert kept.filter("live <= 0").count() == 0


@pytest.mark.parametrize("corrected", [False, True])
def test_congestion_after_changed_events(given, corrected):
    parts = lambda calls, events: matviews.congestion_parts(calls, events, corrected)
    old, calls = given.tracking_events, given.port_calls
    draw = drawn(5, F.col("id"))
    new = old.filter(draw > 0).withColumn("is_exception", F.when(draw == 1, ~F.col("is_exception")).otherwise(F.col("is_exception")))
    touched = old.filter(draw <= 1).select("port_id", "event_time").distinct()
    reach = F.expr("interval 2 days")
    near = calls.join(touched, "port_id").filter(F.col("event_time").between(F.col("scheduled_arrival") - reach, F.col("scheduled_arrival") + reach)).select("id").distinct()
    part = calls.join(near, "id", "left_semi")
    kept = matviews.with_changes(parts(calls, old), parts(part, old), parts(part, new), matviews.KEYS["mv_port_congestion"])
    assert rows(matviews.congestion_finish(kept)) == rows(matviews.congestion_finish(parts(calls, new)))
    assert 0 < part.count()
