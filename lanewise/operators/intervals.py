"""Counting events in time ranges without emitting (range, event) pairs.

A range join of calls and events of one busy port is quadratic. All the reports need is how many
events each range holds, and that is the difference of two running counts: one at the end of the
range, one just before its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.operators.ordering import exclusive_scan, union_all

_SLICE_BITS = 26


def running_counts(events: DataFrame, probes: list[DataFrame], group: list[str], sums: list[str], lasts: list[str] | None = None) -> DataFrame:
    """Running totals of ``sums`` at every instant ``at`` (epoch micros) of the events and the probes.

    Returns one row per (group, at): ``before_<c>`` is the total strictly earlier, ``upto_<c>`` includes
    the instant. ``events`` has group, at and the summed columns; probes have group and at. ``lasts`` are
    struct columns of ``events`` carried forward the same way; at one instant the largest struct wins.
    """
    lasts = lasts or []
    parts = [events.select(*group, "at", *sums, *lasts)]
    for probe in probes:
        nothing = [F.lit(0).cast(events.schema[c].dataType).alias(c) for c in sums]
        nothing += [F.lit(None).cast(events.schema[c].dataType).alias(c) for c in lasts]
        parts.append(probe.select(*group, "at", *nothing))
    cells = (
        union_all(parts)
        .groupBy(*group, F.shiftright("at", _SLICE_BITS).alias("at_slice"), "at")
        .agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in lasts])
    )
    scanned = exclusive_scan(cells, group, ["at_slice", "at"], sums=sums, lasts=lasts)
    return scanned.select(
        *group,
        "at",
        *[F.col(f"before_{c}") for c in sums],
        *[(F.col(f"before_{c}") + F.col(c)).alias(f"upto_{c}") for c in sums],
        *[F.col(f"before_{c}") for c in lasts],
        *[F.coalesce(c, f"before_{c}").alias(f"upto_{c}") for c in lasts],
    )


def counts_in_ranges(ranges: DataFrame, events: DataFrame, group: list[str], sums: list[str], low: Column, high: Column) -> DataFrame:
    """``ranges`` (one row per distinct group and range) with the totals of events in [low, high]."""
    ranges = ranges.withColumns({"_low": low, "_high": high})
    probes = [ranges.select(*group, F.col(c).alias("at")) for c in ("_low", "_high")]
    scanned = running_counts(events, probes, group, sums)
    starts = scanned.select(*group, F.col("at").alias("_low"), *[F.col(f"before_{c}").alias(f"_low_{c}") for c in sums])
    ends = scanned.select(*group, F.col("at").alias("_high"), *[F.col(f"upto_{c}").alias(f"_high_{c}") for c in sums])
    out = ranges.join(starts, [*group, "_low"]).join(ends, [*group, "_high"])
    return out.withColumns({c: F.col(f"_high_{c}") - F.col(f"_low_{c}") for c in sums}).drop(
        "_low", "_high", *[f"_low_{c}" for c in sums], *[f"_high_{c}" for c in sums]
    )
