"""Derived columns as chainable operators over shipments."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lanewise.functions import columns as C


def with_delay_flag(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumn("is_delayed", C.is_delayed(as_of))


def with_value_tier(df: DataFrame) -> DataFrame:
    return df.withColumn("value_tier", C.value_tier())


def with_transit_duration(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumn("transit_duration", C.transit_duration(as_of))


def with_hours_overdue(df: DataFrame, as_of: str) -> DataFrame:
    return df.withColumn("hours_overdue", C.hours_overdue(as_of))
