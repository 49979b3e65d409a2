"""Merged daily sketches against exact figures."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lanewise.plans import sketches


@pytest.fixture(scope="module")
def shipments(spark):
    rnd, rows = random.Random(8), []
    for k in range(40_000):
        left = datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(24 * 90))
        carrier = "big" if k % 3 else f"c{k % 7}"
        days = rnd.lognormvariate(2, 1)
        rows.append((carrier, f"s{rnd.randrange(5000 if carrier == 'big' else 20)}", "DELIVERED" if k % 11 else "IN_TRANSIT", left, left + timedelta(days=days) if k % 13 else None))
    return spark.createDataFrame(rows, "carrier_id string, shipper_id string, status string, departure_date timestamp, actual_arrival timestamp").repartition(5).cache()


@pytest.mark.parametrize(("start", "end"), [(None, None), ("2024-02-01", "2024-02-20"), ("2030-01-01", None)])
def test_figures_are_as_near_as_stated(shipments, start, end):
    got = {r["carrier_id"]: r for r in sketches.between(sketches.daily_sketches(shipments), start, end).collect()}
    exact = {}
    for r in sketches.delivered_days(shipments).collect():
        if (start is None or str(r["day"]) >= start) and (end is None or str(r["day"]) <= end):
            exact.setdefault(r["carrier_id"], []).append((r["transit_days"], r["shipper_id"]))
    assert set(got) == set(exact)
    for carrier, rows in exact.items():
        days, n = [d for d, _ in rows], len(rows)
        assert got[carrier]["sample_size"] == n
        for name, rank in (("median_days", 0.5), ("p95_days", 0.95)):
            value = got[carrier][name]
            assert sum(d < value for d in days) / n <= rank + 0.02 and sum(d <= value for d in days) / n >= rank - 0.02
        assert abs(got[carrier]["customers"] - len({s for _, s in rows})) <= 0.05 * len({s for _, s in rows}) + 1


def test_merging_days_one_by_one(shipments):
    daily = sketches.daily_sketches(shipments)
    assert daily.filter(F.length("transit") > 10_000).count() == 0 and daily.groupBy("carrier_id", "day").count().filter("count > 1").count() == 0
    assert sketches.between(daily.limit(0)).count() == 0
