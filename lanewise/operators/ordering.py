"""Ordered scans (running sums, positions, previous row) whose work splits at any skew.

``Window`` without PARTITION BY sends every row to one task, and a window partitioned by a
carrier sends a third of the fleet to one task when that carrier owns a third of the rows.
The scan here gives the same answers from bounded pieces:

* every ordering column becomes a non-null sortable value plus one or two coarser *slices* of it
  (a timestamp's slice is about a minute; a bigint has slices of 2^22 and of 2^44 values);
* rows are totalled per slice first (partial aggregation, so a hot key costs nothing extra);
* the scan runs over the slice totals, then inside each slice, each level starting from
  what its parent slice had before it.

So the widest window is one slice, not one key: at most 2^22 entries for a bigint or decimal whatever
its values, one entry per minute at the top of a timestamp (about 16 million for 30 years). Nothing is collected.

Row numbers and previous rows go by whole keys, strings too, and use ``ranged_scan``, which deals the rows by range instead.

The input is read once per level, so it must give the same rows each time: pass a frame with an
unordered ``limit`` or a random column through ``sources.checkpoints.materialized`` first.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lanewise.sources.checkpoints import materialized

_STRING_SLICE = 3
_LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Key:
    """An ordering column. NULLs sort last unless ``nulls_first``; strings sort ascending only.

    ``slices`` overrides the bit widths of its slices, widest first. ``slices=()`` saves a level for a
    number with few distinct values, such as a row count per group: k different counts need at least
    k * k / 2 rows, so 10^11 rows have under 450 000 of them.
    """

    column: str
    descending: bool = False
    nulls_first: bool = False
    slices: tuple[int, ...] | None = None


def _slices(dtype: T.DataType) -> tuple[int, ...]:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return (26,)
    if isinstance(dtype, (T.DateType, T.ShortType, T.ByteType)):
        return ()
    if isinstance(dtype, T.IntegerType):
        return (16,)
    if isinstance(dtype, T.DecimalType) and dtype.precision <= 13:
        return (22,)
    return (44, 22)


def sortable(dtype: T.DataType, column: Column) -> Column:
    """A bigint in the same order as ``column`` (strings stay strings)."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(dtype, T.DecimalType):
        if dtype.precision > 18:
            raise TypeError(f"cannot order by {dtype.simpleString()}: at most 18 digits")
        return (column * F.lit(10**dtype.scale).cast("decimal(19,0)")).cast("long")
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("long")
    if isinstance(dtype, T.StringType):
        return column
    raise TypeError(f"cannot order by {dtype.simpleString()}")


def with_levels(df: DataFrame, keys: list[Key], prefix: str = "_k") -> tuple[DataFrame, list[str]]:
    """Add the slice and value columns of each key; returns the frame and their names, coarse to fine."""
    columns: dict[str, Column] = {}
    for n, key in enumerate(keys):
        dtype = df.schema[key.column].dataType
        value = sortable(dtype, F.col(key.column))
        if isinstance(dtype, T.StringType):
            if key.descending or key.nulls_first:
                raise TypeError("string keys sort ascending, NULLs last")
            columns[f"{prefix}{n}s"] = F.coalesce(F.substring(value, 1, _STRING_SLICE), F.lit("\U0010ffff"))
            columns[f"{prefix}{n}"] = F.coalesce(value, F.lit("\U0010ffff"))
            continue
        if key.descending:
            value = F.bitwise_not(value)
        value = F.coalesce(value, F.lit(-_LAST if key.nulls_first else _LAST))
        for bits in _slices(dtype) if key.slices is None else key.slices:
            columns[f"{prefix}{n}s{bits}"] = F.shiftright(value, bits)
        columns[f"{prefix}{n}"] = value
    return df.withColumns(columns), list(columns)


def _null_safe(df: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    """Group columns that can be joined on even where NULL: a value and a flag for each."""
    columns: dict[str, Column] = {}
    for n, name in enumerate(group):
        dtype = df.schema[name].dataType
        text = {T.StringType: "", T.DateType: "1970-01-01"}
        blank = F.lit(text.get(type(dtype), 0)).cast(dtype)
        columns[f"_g{n}"] = F.coalesce(F.col(name), blank)
        columns[f"_g{n}null"] = F.col(name).isNull()
    return df.withColumns(columns) if columns else df, list(columns)


def exclusive_scan(
    df: DataFrame,
    group: list[str],
    levels: list[str],
    sums: list[str] = (),
    lasts: list[str] = (),
    totals: list[str] = (),
) -> DataFrame:
    """What came before each row, in ``levels`` order within ``group`` (NULL is a group of its own).

    ``df`` has at most one row per (group, levels). Adds ``before_<c>``: for ``sums`` the total over
    earlier rows (0 for the first), for ``lasts`` the value of the latest earlier row where it is not
    NULL. ``totals`` (a subset of sums) adds ``total_<c>``, the sum over the whole group.
    """
    df, group = _null_safe(df, list(group))
    tiers = [df]
    for depth in range(len(levels) - 1, 0, -1):
        edge = F.col(levels[depth])
        tiers.append(
            tiers[-1]
            .groupBy(*group, *levels[:depth])
            .agg(
                *[F.sum(c).alias(c) for c in sums],
                *[F.max_by(c, F.when(F.col(c).isNotNull(), edge)).alias(c) for c in lasts],
            )
        )
    carried = [f"before_{c}" for c in (*sums, *lasts)] + [f"total_{c}" for c in totals]
    offsets = None
    for depth, tier in enumerate(reversed(tiers)):
        parent = [*group, *levels[:depth]]
        every = Window.partitionBy(*parent)
        earlier = every.orderBy(levels[depth]).rowsBetween(Window.unboundedPreceding, -1)
        local = {f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums}
        local |= {f"before_{c}": F.last(c, ignorenulls=True).over(earlier) for c in lasts}
        if offsets is None:
            local |= {f"total_{c}": F.sum(c).over(every) for c in totals}
            scanned = tier.withColumns(local)
        else:
            scanned = tier.withColumns({f"_in_{name}": column for name, column in local.items()})
            scanned = scanned.join(offsets, parent)
            scanned = scanned.withColumns(
                {f"before_{c}": F.col(f"before_{c}") + F.col(f"_in_before_{c}") for c in sums}
                | {f"before_{c}": F.coalesce(f"_in_before_{c}", f"before_{c}") for c in lasts}
            ).drop(*[f"_in_{name}" for name in local])
        offsets = scanned.select(*group, *levels[: depth + 1], *carried)
    return scanned.drop(*group)


def ranged_scan(df: DataFrame, group: list[str], keys: list[Key], sums: list[str] = (), lasts: list[str] = (), totals: list[str] = ()) -> DataFrame:
    """:func:`exclusive_scan` over whole key values of any type; ``keys`` are unique within ``group``.

    Rows are dealt by range over (group, keys), so equal shares whatever the values have in common: ids with one
    prefix, a third of the rows on one instant, or in one group. They are written once, with the number of their range, so that
    the totals per (group, range) and the scan inside a range see the same ranges. A group's ranges meet in one window: a row each.
    """
    df, group = _null_safe(df, list(group))
    rows, levels = with_levels(df, list(keys))
    values = [f"_k{n}" for n in range(len(keys))]
    rows = rows.drop(*[c for c in levels if c not in values])
    dealt = rows.repartitionByRange(*group, *values).withColumn("_range", F.spark_partition_id())
    dealt = materialized(dealt)
    edge = F.struct(*values)
    per_range = dealt.groupBy(*group, "_range").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), edge)).alias(c) for c in lasts],
    )
    whole = Window.partitionBy(*group)
    ranges_before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *group,
        "_range",
        *[F.coalesce(F.sum(c).over(ranges_before), F.lit(0)).alias(f"before_{c}") for c in sums],
        *[F.last(c, ignorenulls=True).over(ranges_before).alias(f"before_{c}") for c in lasts],
        *[F.sum(c).over(whole).alias(f"total_{c}") for c in totals],
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*values).rowsBetween(Window.unboundedPreceding, -1)
    scanned = dealt.withColumns(
        {f"_in_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums} | {f"_in_{c}": F.last(c, ignorenulls=True).over(inside) for c in lasts}
    )
    scanned = scanned.join(offsets, [*group, "_range"]).withColumns(
        {f"before_{c}": F.col(f"before_{c}") + F.col(f"_in_{c}") for c in sums} | {f"before_{c}": F.coalesce(f"_in_{c}", f"before_{c}") for c in lasts}
    )
    return scanned.drop(*group, *values, "_range", *[f"_in_{c}" for c in (*sums, *lasts)])


def positions(df: DataFrame, keys: list[Key], group: list[str] = (), into: str = "position", total: str | None = None, whole: bool = False) -> DataFrame:
    """1-based row number in ``keys`` order within ``group``; the last key must be unique.

    ``whole``: each group is known to fit a task, and is numbered there, with no shuffle if ``df`` is dealt by the group already.
    """
    if whole:
        rows, levels = with_levels(df, list(keys))
        every = Window.partitionBy(*group)
        added = {into: F.row_number().over(every.orderBy(*[f"_k{n}" for n in range(len(keys))])).cast("long")}
        if total:
            added[total] = F.count("*").over(every)
        return rows.withColumns(added).drop(*levels)
    rows = df.withColumn("_one", F.lit(1).cast("long"))
    scanned = ranged_scan(rows, list(group), list(keys), sums=["_one"], totals=["_one"] if total else [])
    added = {into: F.col("before__one") + 1}
    if total:
        added[total] = F.col("total__one")
    return scanned.withColumns(added).drop("_one", "before__one", "total__one")


def previous(df: DataFrame, column: str, keys: list[Key], group: list[str] = (), into: str = "previous") -> DataFrame:
    """``column`` of the row before, in ``keys`` order within ``group``; NULL values are kept as they are."""
    rows = df.withColumn("_cell", F.struct(F.col(column).alias("v")))
    scanned = ranged_scan(rows, list(group), list(keys), lasts=["_cell"])
    return scanned.withColumn(into, F.col("before__cell")["v"]).drop("_cell", "before__cell")


def peer_totals(df: DataFrame, key: Key, measures: dict[str, Column], group: list[str] = ()) -> DataFrame:
    """Per distinct value of ``key``: each measure over strictly earlier values (``before_``), over the
    value itself (same name) and over the whole group (``total_``). This is the RANGE frame, where
    equal keys share one answer. The key comes back as ``_k0`` (see ``with_levels``)."""
    rows, levels = with_levels(df, [key])
    cells = rows.groupBy(*group, *levels).agg(*[m.alias(name) for name, m in measures.items()])
    names = list(measures)
    return exclusive_scan(cells, list(group), levels, sums=names, totals=names).drop(*levels[:-1])


def with_peer_totals(df: DataFrame, key: Key, measures: dict[str, Column], group: list[str] = ()) -> DataFrame:
    """Rows of ``df`` with the ``peer_totals`` of their key. The totals side has one row per value,
    so a hot value skews only the row side, which the adaptive skew join splits."""
    rows, levels = with_levels(df, [key])
    return rows.join(peer_totals(df, key, measures, group), [*group, levels[-1]]).drop(*levels)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
