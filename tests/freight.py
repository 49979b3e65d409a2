"""What the freight tests share."""

from __future__ import annotations

AS_OF = "2024-03-01 12:00:00"


def ids(df) -> set:
    return {row["id"] for row in df.collect()}
