"""The bounded scans against direct computation, with ties, NULLs, hot keys and both key types."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lanewise.operators import windows
from lanewise.operators.intervals import counts_in_ranges
from lanewise.operators.ordering import Key, positions, previous


def _rows(seed: int, n: int, string_ids: bool):
    rng = random.Random(seed)
    base = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        hot = rng.random() < 0.4  # one carrier and one instant hold a large share
        carrier = "big" if hot else None if rng.random() < 0.1 else f"c{rng.randrange(4)}"
        at = None if rng.random() < 0.1 else base if hot and rng.random() < 0.7 else base + timedelta(seconds=rng.randrange(500), days=rng.randrange(3))
        value = None if rng.random() < 0.2 else Decimal(rng.randrange(-5, 40)) * Decimal("2500.25")
        ident = f"{rng.getrandbits(64):016x}-{i}" if string_ids else rng.getrandbits(62) - (1 << 61)
        out.append((ident, carrier, at, value))
    return out


@pytest.fixture(scope="module", params=[True, False], ids=["string ids", "bigint ids"])
def frame(spark, request):
    kind = "string" if request.param else "bigint"
    rows = _rows(7, 400, request.param)
    return spark.createDataFrame(rows, f"id {kind}, carrier_id string, departure_date timestamp, declared_value decimal(18,2)").repartition(5)


def _same(left, right, *columns):
    pick = lambda df: sorted((tuple(str(r[c]) for c in ("id", *columns)) for r in df.collect()))
    assert pick(left) == pick(right)


def test_row_number_by_carrier(frame):
    w = Window.partitionBy("carrier_id").orderBy(F.asc_nulls_last("departure_date"), "id")
    _same(windows.with_row_number_by_carrier(frame), frame.withColumn("carrier_row_num", F.row_number().over(w)), "carrier_row_num")


def test_positions_over_everything_and_total(frame):
    got = positions(frame, [Key("declared_value", descending=True), Key("id")], total="rows")
    w = Window.orderBy(F.desc_nulls_last("declared_value"), "id")
    _same(got, frame.withColumn("position", F.row_number().over(w)).withColumn("rows", F.lit(400)), "position", "rows")


def test_positions_nulls_first(frame):
    got = positions(frame, [Key("declared_value", nulls_first=True), Key("id")])
    w = Window.orderBy(F.asc_nulls_first("declared_value"), "id")
    _same(got, frame.withColumn("position", F.row_number().over(w)), "position")


def test_previous_keeps_nulls(frame):
    got = previous(frame, "declared_value", [Key("departure_date"), Key("id")], ["carrier_id"], into="before")
    w = Window.partitionBy("carrier_id").orderBy(F.asc_nulls_last("departure_date"), "id")
    _same(got, frame.withColumn("before", F.lag("declared_value").over(w)), "before")


def test_running_total_shares_ties(frame):
    w = Window.orderBy(F.asc_nulls_last("departure_date"))
    want = frame.withColumn("running_total_value", F.sum(F.coalesce("declared_value", F.lit(0))).over(w).cast("decimal(38,2)"))
    _same(windows.with_running_total_value(frame), want, "running_total_value")


def test_quartiles(frame):
    w = Window.orderBy(F.asc_nulls_last("declared_value"), "id")
    _same(windows.with_quartile_by_value(frame), frame.withColumn("value_quartile", F.ntile(4).over(w)), "value_quartile")


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_quartiles_of_few_rows(frame, n):
    few = frame.orderBy("id").limit(n)
    w = Window.orderBy(F.asc_nulls_last("declared_value"), "id")
    _same(windows.with_quartile_by_value(few), few.withColumn("value_quartile", F.ntile(4).over(w)), "value_quartile")


def test_percent_rank(frame):
    weighed = frame.withColumn("total_gross_weight_kg", F.col("declared_value").cast("decimal(16,3)"))
    w = Window.orderBy(F.coalesce("total_gross_weight_kg", F.lit(0).cast("decimal(16,3)")))
    want = weighed.withColumn("weight_percentile_rank", F.percent_rank().over(w))
    _same(windows.with_percentile_rank_by_weight(weighed), want, "weight_percentile_rank")
    one = weighed.orderBy("id").limit(1)
    assert windows.with_percentile_rank_by_weight(one).first()["weight_percentile_rank"] == 0.0


def test_carrier_rank(frame):
    frame = frame.filter("carrier_id IS NOT NULL")
    counted = frame.withColumn("n", F.count("*").over(Window.partitionBy("carrier_id")))
    want = counted.withColumn("carrier_volume_rank", F.dense_rank().over(Window.orderBy(F.desc("n"))))
    _same(windows.with_carrier_rank_by_volume(frame), want, "carrier_volume_rank")


def test_moving_average_in_days(frame):
    dated = frame.filter("departure_date IS NOT NULL")
    w = Window.orderBy(F.unix_micros("departure_date")).rangeBetween(-86_400_000_000, 0)
    value = F.coalesce("declared_value", F.lit(0).cast("decimal(18,2)"))
    want = dated.withColumn("moving_avg_value", F.round(F.avg(value).over(w), 6).cast("decimal(28,6)"))
    _same(windows.with_moving_avg_value(dated, window_days=1), want, "moving_avg_value")
    assert windows.with_moving_avg_value(frame, window_days=1).count() == 400


def test_empty(frame):
    assert windows.with_row_number_by_carrier(frame.filter("false")).count() == 0
    assert windows.with_quartile_by_value(frame.filter("false")).count() == 0


def test_range_counts_include_both_ends(spark):
    rng = random.Random(3)
    events = [(rng.choice("aab"), rng.randrange(60), 1) for _ in range(200)]
    ranges = sorted({(rng.choice("abc"), rng.randrange(60)) for _ in range(60)})
    frame = spark.createDataFrame(events, "g string, at bigint, n bigint").groupBy("g", "at").agg(F.sum("n").alias("n"))
    asked = spark.createDataFrame(ranges, "g string, mid bigint")
    got = counts_in_ranges(asked, frame, ["g"], ["n"], F.col("mid") - 5, F.col("mid") + 5).collect()
    assert {(r["g"], r["mid"]): r["n"] for r in got} == {(g, m): sum(1 for e in events if e[0] == g and m - 5 <= e[1] <= m + 5) for g, m in ranges}


def test_no_window_without_partition_over_rows(frame):
    """Windows of the global scans over rows are split by range; the one over everything has a row a range."""
    plan = windows.with_quartile_by_value(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "ntile" not in plan
    over_rows = [line for line in plan.splitlines() if "Window" in line and "_k0" in line]
    assert over_rows and all("[_range#" in line for line in over_rows)


def test_ids_with_one_prefix_are_dealt_evenly(spark):
    """A third of the rows on one instant and in one group, all ids alike but for their end."""
    n = 30_000
    rows = spark.range(n).select(
        F.format_string("GT-SEED-2024-%012d", F.col("id")).alias("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.when(F.col("id") % 3 == 1, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("timestamp").alias("at"),
    )
    numbered = positions(rows, [Key("at"), Key("id")], ["g"], into="n", total="all")
    got = numbered.groupBy("g").agg(F.count("*").alias("rows"), F.countDistinct("n").alias("numbers"), F.max("n").alias("last"), F.max("all").alias("all")).collect()
    assert all(r["rows"] == r["numbers"] == r["last"] == r["all"] for r in got) and sum(r["rows"] for r in got) == n
    dealt = rows.repartitionByRange(8, "g", "at", "id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert dealt < 2 * n / 8
    before = previous(rows, "id", [Key("id")], into="p").filter("id > 'GT-SEED-2024-000000000000'")
    assert before.filter(F.substring("p", -12, 12).cast("long") != F.substring("id", -12, 12).cast("long") - 1).count() == 0
