"""Keyset pages of the shipment list: a filter on the last row seen, then a top-k. No offsets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import instant
from lanewise.operators.filters import check_range

PAGE_SIZE = 50
MAX_PAGE_SIZE = 200


@dataclass(frozen=True)
class Cursor:
    """The last row of the page before: its departure (None when NULL) and id."""

    departure_date: str | None
    id: object


def page(df: DataFrame, after: Cursor | None = None, size: int = PAGE_SIZE) -> DataFrame:
    """Latest departures first, NULL departures first of all (as the stored order has it), ties by id.

    A page has 1 to ``MAX_PAGE_SIZE`` rows; another size is refused.
    """
    check_range("size", size, 1, MAX_PAGE_SIZE)
    at = F.col("departure_date")
    if after is not None:
        if after.departure_date is None:
            later = at.isNotNull() | (F.col("id") > F.lit(after.id))
        else:
            edge = instant(after.departure_date)
            later = (at < edge) | ((at == edge) & (F.col("id") > F.lit(after.id)))
        df = df.filter(later)
    return df.orderBy(F.desc_nulls_first("departure_date"), "id").limit(size)
