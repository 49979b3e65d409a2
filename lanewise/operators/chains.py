"""Chains of corrections: events that say of another event that they supersede it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.sources.checkpoints import materialized


def correction_chains(events: DataFrame) -> DataFrame:
    """``id, fact_id, depth, is_latest, is_forked, in_cycle`` of every event (``id, supersedes_id``; ids are unique).

    ``fact_id`` is the event that the chain of corrections begins with, ``depth`` how many corrections lead to this one. An event that supersedes
    one that is not there begins a chain. ``is_latest``: nothing supersedes it; a chain without forks has one such event, its current
    fact. ``is_forked``: its chain has an event that two others supersede. ``in_cycle``: it leads back to itself or into such a circle, so it has
    no fact and no depth.

    Each round doubles the distance looked back, so there are as many as the longest chain's logarithm. Only events of chains take part.
    """
    present = events.select(F.col("id").alias("supersedes_id"))
    links = events.filter("supersedes_id IS NOT NULL").select("id", "supersedes_id").join(present, "supersedes_id", "left_semi")
    links = materialized(links.select("id", "supersedes_id"))
    ways, reach, most = links.select("id", F.col("supersedes_id").alias("up"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("open")), 1, links.count()
    while not (ways := _settled(ways)).filter("open").isEmpty() and reach <= most:
        further = ways.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        ways = ways.join(further, "up", "left").select("id", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.lit(True).alias("open"))
        reach *= 2
    times = links.groupBy(F.col("supersedes_id").alias("id")).agg(F.count(F.lit(1)).alias("times"))
    told = events.select("id").join(ways.withColumnRenamed("open", "in_cycle"), "id", "left").join(times, "id", "left")
    cyclic = F.coalesce("in_cycle", F.lit(False))
    told = told.select("id", F.when(~cyclic, F.coalesce("up", "id")).alias("fact_id"), F.when(~cyclic, F.coalesce("depth", F.lit(0))).alias("depth"), F.col("times").isNull().alias("is_latest"), cyclic.alias("in_cycle"), "times")
    forked = told.filter("times > 1 AND fact_id IS NOT NULL").select("fact_id").distinct().withColumn("_forked", F.lit(True))
    of_chain = told.join(forked, "fact_id", "left").withColumn("is_forked", F.coalesce("_forked", F.lit(False)))
    return of_chain.select("id", "fact_id", "depth", "is_latest", "is_forked", "in_cycle")


def _settled(ways: DataFrame) -> DataFrame:
    """Which ways still end at an event that supersedes another."""
    ends = ways.select(F.col("id").alias("up"), F.lit(True).alias("_more"))
    return materialized(ways.drop("open").join(ends, "up", "left").select("id", "up", "depth", F.coalesce("_more", F.lit(False)).alias("open")))


def current_facts(events: DataFrame) -> DataFrame:
    """The events that hold: of every chain the latest, of a forked one each latest; circles hold nothing."""
    latest = correction_chains(events.select("id", "supersedes_id")).filter("is_latest AND NOT in_cycle").select("id")
    return events.join(latest, "id", "left_semi")
