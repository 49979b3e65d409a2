"""Reading, listing and writing plain tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.sources.checkpoints import materialized
from lanewise.sources.schemas import DEFAULT_ORDER, TABLES


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """A typed scan; the schema is stated, never inferred."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {sorted(TABLES)}")
    reader = spark.readStream if stream else spark.read
    return reader.schema(TABLES[name]).format(fmt).load(f"{root}/{name}")


def in_default_order(df: DataFrame, table: str) -> DataFrame:
    """Sorted as the table is listed by default, NULLs last ascending and first descending, then by id."""
    if not DEFAULT_ORDER[table]:
        return df
    columns = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in DEFAULT_ORDER[table]]
    return df.orderBy(*columns, "id")


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``. A partial aggregate keeps one row per key and task,
    so many copies of one key never meet in one place."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*key, "_row.*").select(*df.columns)


def new_rows(existing: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, one per key."""
    return first_per_key(rows, key, order).join(existing.select(*key), key, "left_anti")


def new_rows_under(existing: DataFrame, rows: DataFrame, keys: list[list[str]], order: list[str]) -> DataFrame:
    """Rows that an append in ``order`` under several unique keys stores, where a row that clashes under any key is left out.

    A row is stored if no stored row and no row before it that is stored has its values of any key. A row left out for one key
    frees its values of the others. A key with a null clashes with nothing. Rows equal in ``order`` are stored in order of their hash.

    Each round stores the rows that come first under all their keys and leaves out those that clash with them; rounds
    are half as many as the longest chain of rows each of which decides the next.
    """
    known = [F.lit(True) if not k else reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in k]) for k in keys]
    open_ = rows
    for key in keys:
        open_ = open_.join(existing.select(*key).dropna().distinct(), key, "left_anti").select(*rows.columns)
    place = F.struct(*order, F.xxhash64(*rows.columns).alias("_hash"), F.monotonically_increasing_id().alias("_row"))
    open_, stored = materialized(open_.withColumn("_place", place)), None
    while not open_.isEmpty():
        first = open_
        for n, key in enumerate(keys):
            least = open_.filter(known[n]).groupBy(*key).agg(F.min("_place").alias(f"_least{n}"))
            first = first.join(least, key, "left").filter(F.col(f"_least{n}").isNull() | (F.col(f"_least{n}") == F.col("_place"))).select(*open_.columns)
        first = materialized(first)
        rest = open_.join(first.select("_place"), "_place", "left_anti").select(*open_.columns)
        for key in keys:
            rest = rest.join(first.select(*key).dropna().distinct(), key, "left_anti").select(*open_.columns)
        stored, open_ = first if stored is None else stored.unionByName(first), materialized(rest)
    return rows.limit(0) if stored is None else stored.select(*rows.columns)


def append_ignoring_conflicts(path: str, existing: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> None:
    """Append rows that do not clash on ``key`` with stored rows or with each other."""
    new_rows(existing, rows, key, order).write.mode("append").parquet(path)


def get_or_create(existing: DataFrame, wanted: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The stored row for each wanted key, else the wanted row; ``created`` tells which."""
    created = new_rows(existing, wanted, key, order).withColumn("created", F.lit(True))
    found = existing.join(wanted.select(*key), key, "left_semi").withColumn("created", F.lit(False))
    return found.unionByName(created)


def without(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that stay after deleting those where ``condition`` is true; write them as a new version."""
    return df.filter(~F.coalesce(condition, F.lit(False)))
