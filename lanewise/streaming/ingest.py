"""Carrier message ingest: authenticate, parse, de-duplicate, match, and keep the unmatched for a day.

Every sink is a directory per micro-batch, written with overwrite, so a replayed batch replaces its own
output: the log holds each event once. Waiting messages are carried from batch to batch the same way. A batch has one
instant, stored before anything else, so its parts and its replays agree on what is due.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanewise.functions.signatures import pads, signature_valid
from lanewise.plans import jobs
from lanewise.sources.folders import exists, subfolders
from lanewise.sources.schemas import ENVELOPE

# fixed length limits of the envelope
_MAX_LENGTH = {"webhook_id": 128, "event_type": 64, "shipment_reference": 64}

_WAITING = (
    "webhook_id string, carrier_code string, event_type string, shipment_reference string, event_timestamp timestamp, "
    "payload map<string,string>, received_at timestamp, retries int, next_try_at timestamp"
)


def _trimmed(column: str) -> Column:
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def parse(messages: DataFrame, carriers: DataFrame) -> DataFrame:
    """Parsed envelopes with ``reason``: why a message is refused, or NULL.

    ``messages`` has carrier_code, raw_body, signature, received_at. Ids and types are trimmed; blank ones are malformed.
    Refused messages are for a quarantine sink.
    """
    secret = F.get_json_object("service_metadata", "$.webhook_secret")
    inner, outer = pads(secret)
    working = carriers.filter("is_active").select("carrier_code", secret.alias("_secret"), inner.alias("_inner"), outer.alias("_outer"), F.lit(True).alias("_known"))
    body = F.from_json(F.decode("raw_body", "UTF-8"), ENVELOPE)
    joined = messages.join(working, "carrier_code", "left").withColumn("_body", body)
    flat = joined.select("*", "_body.*").withColumns({c: _trimmed(c) for c in _MAX_LENGTH})
    bad = [F.coalesce(F.length(c) == 0, F.lit(True)) | (F.length(c) > limit) for c, limit in _MAX_LENGTH.items()]
    malformed = bad[0] | bad[1] | bad[2] | F.col("event_timestamp").isNull()
    reason = (
        F.when(F.col("_known").isNull(), "unknown_carrier")
        .when(F.coalesce("_secret", F.lit("")) == "", "no_secret")
        .when(~signature_valid(F.col("raw_body"), F.col("signature"), F.col("_inner"), F.col("_outer")), "bad_signature")
        .when(malformed, "malformed")
    )
    return flat.withColumn("reason", reason).drop("_secret", "_inner", "_outer", "_known", "_body")


def accepted(parsed: DataFrame) -> DataFrame:
    payload = F.coalesce("payload", F.create_map().cast("map<string,string>"))
    return parsed.filter("reason IS NULL").select(
        "webhook_id", "carrier_code", "event_type", "shipment_reference", "event_timestamp", payload.alias("payload"), "received_at", F.lit(0).alias("retries")
    )


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason IS NOT NULL").select("carrier_code", "raw_body", "signature", "received_at", "reason")


def deduplicated(stream: DataFrame) -> DataFrame:
    """One message per webhook id within a day of arrival, with state that expires."""
    return stream.withWatermark("received_at", "24 hours").dropDuplicatesWithinWatermark(["webhook_id"])


class Ingest:
    """The stateful half: matches a micro-batch together with the messages still waiting.

    The ids it has handled are kept in a sink of their own, one narrow column by day of arrival, so that a batch need
    not parse the event log. All of them are read, or, with ``retention_days``, those of the days since so many before the batch's
    earliest message: a carrier that repeats a message later than that is recorded again, under the same event id. Only sinks of earlier
    batches are read, which is what makes a replay safe.
    """

    def __init__(self, root: str, tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], now: Callable[[], Column] = F.current_timestamp, retention_days: int | None = None):
        """``tables`` gives (webhook ids handled by others, carriers, shipments) as of the batch; ``now`` is its clock, read once a batch."""
        self.root, self.tables, self.now, self.retention_days = root.rstrip("/"), tables, now, retention_days

    def _path(self, sink: str, batch: int) -> str:
        return f"{self.root}/{sink}/batch={batch}"

    def _write(self, df: DataFrame, sink: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self._path(sink, batch))

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/events")

    def instant(self, spark: SparkSession, batch: int) -> Column:
        """The batch's instant: the stored one if the batch is replayed, else the clock's, stored now."""
        path = self._path("clock", batch)
        if not exists(spark, f"{path}/_SUCCESS"):
            spark.range(1).select(F.unix_micros(self.now().cast("timestamp")).alias("micros")).write.mode("overwrite").parquet(path)
        return F.timestamp_micros(F.lit(spark.read.schema("micros long").parquet(path).first()["micros"]))

    def _handled(self, others: DataFrame, arrived: DataFrame, batch: int) -> DataFrame:
        """Ids handled by others, and by earlier batches on the days in reach."""
        spark, folder = others.sparkSession, f"{self.root}/handled"
        first = arrived.agg(F.min(F.unix_date(F.to_date("received_at")))).first()[0]
        if first is None:
            return others.select("webhook_id")
        days = [d for d in subfolders(spark, folder) if self.retention_days is None or int(d.removeprefix("day=")) >= first - self.retention_days]
        if not days:
            return others.select("webhook_id")
        own = spark.read.option("basePath", folder).schema("webhook_id string, day int, batch long").parquet(*[f"{folder}/{d}" for d in days])
        return others.select("webhook_id").unionByName(own.filter(F.col("batch") < batch).select("webhook_id"))

    def _keep_handled(self, matched: DataFrame, batch: int) -> None:
        ids = matched.filter("status = 'matched'").select("webhook_id", F.coalesce(F.unix_date(F.to_date("received_at")), F.lit(0)).alias("day"), F.lit(batch).cast("long").alias("batch"))
        ids.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.root}/handled")

    def _waiting(self, spark: SparkSession, batch: int) -> DataFrame:
        return spark.read.schema(_WAITING).parquet(self._path("waiting", batch - 1)) if batch else spark.createDataFrame([], _WAITING)

    def __call__(self, messages: DataFrame, batch: int) -> None:
        others, carriers, shipments = self.tables()
        now = self.instant(messages.sparkSession, batch)
        parsed = parse(messages, carriers).persist()
        try:
            self._write(quarantined(parsed), "quarantine", batch)
            matched, later = self.settled(accepted(parsed), self._waiting(messages.sparkSession, batch), others, carriers, shipments, now, batch)
            matched = matched.persist()
            self._write(jobs.message_events(matched, now), "events", batch)
            self._keep_handled(matched, batch)
            done = matched.filter("status NOT IN ('matched', 'retry')")
            self._write(done.select("webhook_id", "carrier_code", "shipment_reference", "status"), "closed", batch)
            self._write(jobs.still_waiting(matched, now).unionByName(later), "waiting", batch)
            matched.unpersist()
        finally:
            parsed.unpersist()

    def settled(self, fresh: DataFrame, waiting: DataFrame, others: DataFrame, carriers: DataFrame, shipments: DataFrame, now: Column, batch: int) -> tuple[DataFrame, DataFrame]:
        """(status of every fresh or due message, messages that go on waiting): each message is in one of the two.

        ``now`` is one literal instant. Of several messages with one webhook id in a batch the earliest counts for all.
        """
        flagged = waiting.withColumn("_due", F.coalesce(F.col("next_try_at") <= now, F.lit(True)))
        due = flagged.filter("_due").drop("next_try_at", "_due")
        arrived = fresh.unionByName(due)
        matched = jobs.match_messages(arrived, self._handled(others, arrived, batch), carriers, shipments, now)
        return matched, flagged.filter("NOT _due").drop("_due")


def start(messages: DataFrame, ingest: Ingest, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the ingest over a stream of raw messages.

    Batches are numbered by the checkpoint. A new checkpoint starts at 0 again, so it needs an empty root: with a root that
    has batches of another checkpoint it would replace them, and is refused.
    """
    spark = messages.sparkSession
    if not exists(spark, f"{checkpoint.rstrip('/')}/metadata") and exists(spark, f"{ingest.root}/clock"):
        raise ValueError(f"{ingest.root} holds the batches of another checkpoint; start with that one or with an empty root")
    writer = messages.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
