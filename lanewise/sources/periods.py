"""Datasets kept by period: a refresh writes the periods it touched and publishes them with a new list of periods.

``w-<n>/period=<day>/`` holds what write n gave for the period that begins on that day; ``m-<n>/`` is the list of the
current (period, write) pairs, complete when Spark has marked it so. Readers take the newest complete list, so a refresh never
changes a running read and a failed one leaves nothing visible. Lists but the newest ``keep``, and writes that no kept list
names, are removed: a read may go on for ``keep - 1`` refreshes.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lanewise.sources.folders import exists, removed, subfolders
from lanewise.sources.versions import DuplicateKeyError

_LIST = "period string, write long, ddl string"


class PeriodTable:
    def __init__(self, spark: SparkSession, path: str, key: list[str], column: str, unit: str = "month"):
        """``column``: the date whose ``unit`` (month or week) is the period."""
        self.spark, self.path, self.key, self.column, self.unit = spark, path.rstrip("/"), key, column, unit

    def period_of(self, day: Column) -> Column:
        return F.date_format(F.date_trunc(self.unit, day), "yyyy-MM-dd")

    def _numbers(self, kind: str) -> list[int]:
        return [int(n[2:]) for n in subfolders(self.spark, self.path) if n.startswith(f"{kind}-") and n[2:].isdigit()]

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path}/{kind}-{number:08d}"

    def current(self) -> int | None:
        """The number of the newest complete list."""
        return next((n for n in reversed(self._numbers("m")) if exists(self.spark, f"{self._folder('m', n)}/_SUCCESS")), None)

    def _listed(self, number: int) -> tuple[dict[str, int], str]:
        rows = self.spark.read.schema(_LIST).json(self._folder("m", number)).collect()  # a row a period
        return {r["period"]: r["write"] for r in rows if r["period"]}, rows[0]["ddl"]

    def read(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """All rows, or those with dates from ``since`` to ``until`` (days, both included); periods without such days are not even listed."""
        number = self.current()
        if number is None:
            raise FileNotFoundError(f"nothing published under {self.path}")
        periods, ddl = self._listed(number)
        first = None if since is None else self._first_day(since)
        chosen = {p: n for p, n in periods.items() if (first is None or p >= first) and (until is None or p <= until)}
        paths = [f"{self._folder('w', n)}/period={p}" for p, n in sorted(chosen.items())]
        rows = self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)
        day = F.to_date(self.column)
        for bound, inside in ((since, day >= F.to_date(F.lit(since))), (until, day <= F.to_date(F.lit(until)))):
            rows = rows if bound is None else rows.filter(inside)
        return rows

    def _first_day(self, day: str) -> str:
        """The first day of the period that holds the day."""
        given = date.fromisoformat(day)
        return str(given.replace(day=1) if self.unit == "month" else given - timedelta(days=given.weekday()))

    def publish(self, df: DataFrame, touched: list[str] | None = None, keep: int = 2) -> dict:
        """Publish ``df`` in place of everything, or of the ``touched`` periods (their first days) only.

        A touched period that ``df`` has no rows for goes. Rows outside the touched periods, and two rows of one key, are refused.
        """
        number, last = max([0, *self._numbers("w"), *self._numbers("m")]) + 1, self.current()
        folder, seen = self._folder("w", number), Observation()
        rows = df.withColumn("period", self.period_of(F.col(self.column)))
        # Each task then holds few periods, so a period has few files; large periods are split by key.
        dealt = rows.repartitionByRange("period", *self.key).observe(seen, F.count(F.lit(1)).alias("rows"))
        dealt.write.mode("errorifexists").partitionBy("period").parquet(folder)
        written = [n.removeprefix("period=") for n in subfolders(self.spark, folder)] if exists(self.spark, folder) else []
        if touched is not None and not set(written) <= set(touched):
            raise ValueError(f"rows outside the touched periods: {sorted(set(written) - set(touched))}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        if written:
            clash = self.spark.read.schema(ddl).parquet(*[f"{folder}/period={p}" for p in written]).groupBy(*self.key).count().filter("count > 1").limit(1).collect()
            if clash:
                raise DuplicateKeyError(f"{self.path}: more than one row for {clash[0].asDict()}")
        kept = {} if touched is None or last is None else {p: n for p, n in self._listed(last)[0].items() if p not in touched}
        listed = [*(kept | dict.fromkeys(written, number)).items()] or [(None, None)]
        self.spark.createDataFrame([(p, n, ddl) for p, n in listed], _LIST).coalesce(1).write.json(self._folder("m", number))
        self._clean(keep)
        return {"version": number, "rows": seen.get["rows"], "periods": written}

    def _clean(self, keep: int) -> None:
        lists = [n for n in self._numbers("m") if exists(self.spark, f"{self._folder('m', n)}/_SUCCESS")]
        stay = lists[-keep:]
        used = {w for n in stay for w in self._listed(n)[0].values()}
        for number in self._numbers("m"):
            if number < stay[0]:
                removed(self.spark, self._folder("m", number))
        for number in self._numbers("w"):
            if number < stay[-1] and number not in used:
                removed(self.spark, self._folder("w", number))
