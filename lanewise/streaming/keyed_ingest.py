"""Carrier message ingest on keyed state: a state for each webhook id, a timer for each retry and for the expiry.

Every message is parsed once and handed to the state of its webhook id. The states of the ids of one bucket are one key of Spark's, since a key costs
half a dozen calls between Spark and Python and an Arrow batch. A state asks for a first try at once and, until it hears how the
tries end, for another after 30 * 2**n seconds, the last one when the message is a day old. Tries are matched against the shipments as of their
batch; how they end is written beside the event log and comes back to the state as a second stream, so a try of one batch is settled before the
next batch's timers. Ids whose event was recorded are known for ever unless ``forget_after_seconds`` says otherwise; an id whose message
expired or had no working carrier may come again.

Sinks are a directory per batch, written with overwrite, and all rows of a batch carry its one processing time, so a replayed
batch writes the same rows; batches that say nothing write nothing.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lanewise.plans import jobs
from lanewise.sources.folders import exists
from lanewise.streaming.ingest import parse

_MESSAGE = "carrier_code string, event_type string, shipment_reference string, event_us long, payload string, received_us long"
#: What reaches a key: a message (``kind`` message), a refused one (its reason) or how a try ended (ack: ``outcome``).
_INPUT = f"bucket long, key string, kind string, {_MESSAGE}, raw_body binary, signature string, outcome string"
#: What a key says: ``try`` with the number of retries before it, ``already_processed``, or why a message is refused.
_OUTPUT = f"webhook_id string, {_MESSAGE}, raw_body binary, signature string, retries int, status string, decided_us long"
_ACK = "webhook_id string, outcome string"
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = [c.split()[0] for c in _MESSAGE.split(", ")]
_SAID = Row(*[c.split()[0] for c in _OUTPUT.split(", ")])
#: Buckets of webhook ids. A checkpoint goes on only with as many as it was begun with.
BUCKETS = 1 << 14


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which keyed state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, _STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Retries(StatefulProcessor):
    """The state of one webhook id: the waiting message with its number of retries, or that its event is recorded."""

    def __init__(self, retry_seconds: float, expiry_seconds: float, forget_after_seconds: float | None):
        self.retry_ms, self.expiry_ms = retry_seconds * 1000, expiry_seconds * 1000
        self.forget_ms = None if forget_after_seconds is None else int(forget_after_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", f"{_MESSAGE}, retries int")
        self.recorded = handle.getValueState("recorded", "yes boolean", self.forget_ms) if self.forget_ms else handle.getValueState("recorded", "yes boolean")

    def _row(self, key: str, message: tuple, retries: int, status: str, now: int, raw=None, signature=None) -> Row:
        return _SAID(key, *message, raw, signature, retries, status, now * 1000)

    def _wait(self, message: tuple, retries: int, now: int) -> None:
        """Keep the message and set the next try: after the pause, or when the message expires if that is sooner."""
        self.waiting.update((*message, retries))
        due, end = now + int(self.retry_ms * 2**retries), message[-1] // 1000 + int(self.expiry_ms) + 1
        self.handle.registerTimer(min(due, end) if end > now else due)

    def _done(self) -> None:
        self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, found = timerValues.getCurrentProcessingTimeInMs(), [r.asDict() for r in rows]  # a row looks a name up in all its names
        for outcome in (r["outcome"] for r in found if r["kind"] == "ack"):
            if outcome in ("matched", "already_processed"):
                self.recorded.update((True,))
            if outcome != "retry":
                self._done()
        for r in found:
            if r["kind"] not in ("ack", "message"):
                yield self._row(None, tuple(r[c] for c in _COLUMNS), 0, r["kind"], now, r["raw_body"], r["signature"])
        order = lambda r: [(r[c] is None, r[c]) for c in ("received_us", "carrier_code", "shipment_reference")]
        messages = sorted((r for r in found if r["kind"] == "message"), key=order)
        known = bool(messages) and (self.recorded.exists() or self.waiting.exists())
        for r in messages:
            message = tuple(r[c] for c in _COLUMNS)
            if not known:
                self._wait(message, 0, now)
            yield self._row(key[0], message, 0, "already_processed" if known else "try", now)
            known = True

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.waiting.exists():
            *message, retries = self.waiting.get()
            now = timerValues.getCurrentProcessingTimeInMs()
            self._wait(tuple(message), retries + 1, now)
            yield self._row(key[0], tuple(message), retries + 1, "try", now)

    def close(self) -> None:
        pass


class _State:
    """A value state of the id that its bucket is at."""

    def __init__(self, exists: Callable, get: Callable | None, update: Callable, clear: Callable | None):
        self.exists, self.get, self.update, self.clear = exists, get, update, clear


class Buckets(StatefulProcessor):
    """The states of the webhook ids of one bucket, each of them a :class:`Retries`, for which the bucket is the handle.

    Waiting messages are one value, read and written once a batch; it has those in flight only. Recorded ids are entries of a map, each
    looked up and written on its own, so a message costs the same however many ids are known. The bucket has a timer for each
    instant at which one of its messages is due.
    """

    def __init__(self, *settings: float | None):
        self.one = Retries(*settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getValueState("messages", "waiting string")
        forget = [self.one.forget_ms] if self.one.forget_ms else []
        self.recorded = handle.getMapState("recorded", "webhook_id string", "yes boolean", *forget)
        self.one.init(self)

    def getValueState(self, name: str, *_) -> _State:
        if name == "recorded":
            return _State(self._is_recorded, None, self._record, None)
        return _State(lambda: self.id in self.waiting, lambda: self.waiting[self.id], self._wait, lambda: self.waiting.pop(self.id, None))

    def _is_recorded(self) -> bool:
        if self.any_recorded is None:
            self.any_recorded = self.recorded.exists()
        return self.any_recorded and self.recorded.containsKey((self.id,))

    def _record(self, yes: tuple) -> None:
        self.recorded.updateValue((self.id,), yes)
        self.any_recorded = True

    def _wait(self, message: tuple) -> None:
        self.waiting[self.id] = message

    def registerTimer(self, at: int) -> None:
        self.due[self.id] = at

    def listTimers(self) -> list[int]:
        return []  # those of the bucket follow from what waits

    def _load(self) -> None:
        kept = self.messages.get()
        stored = json.loads(kept[0]) if kept else {}
        self.waiting, self.due = {i: m for i, (_, *m) in stored.items()}, {i: at for i, (at, *_) in stored.items()}
        self.any_recorded, self.before = None, (dict(self.waiting), dict(self.due))

    def _keep(self, now: int) -> None:
        """Store what waits now, and set and delete timers; those that have come are Spark's to delete."""
        self.due = {i: self.due[i] for i in self.waiting}
        if self.before == (self.waiting, self.due):
            return
        if self.waiting:
            self.messages.update((json.dumps({i: (self.due[i], *m) for i, m in self.waiting.items()}),))
        else:
            self.messages.clear()
        was, are = set(self.before[1].values()), set(self.due.values())
        for at in are - was:
            self.handle.registerTimer(at)
        for at in was - are:
            if at > now:
                self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found: dict[str | None, list[Row]] = {}
        for r in rows:
            found.setdefault(r.key, []).append(r)
        self._load()
        for self.id, some in found.items():  # refused messages have no id and no state
            yield from self.one.handleInputRows((self.id,), iter(some), timerValues)
        self._keep(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        self._load()
        for self.id in [i for i, at in self.due.items() if at <= now]:
            yield from self.one.handleExpiredTimer((self.id,), timerValues, expiredTimerInfo)
        self._keep(now)

    def close(self) -> None:
        pass


class KeyedIngest:
    """The sinks below ``root``: events, closed, quarantine, and acks, which the state reads."""

    def __init__(
        self,
        root: str,
        tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame]],
        retry_seconds: float = jobs.RETRY_SECONDS,
        expiry_seconds: float = 3600 * jobs.EXPIRY_HOURS,
        forget_after_seconds: float | None = None,
    ):
        """``tables`` gives (webhook ids handled by others, carriers, shipments) as of the batch."""
        self.root, self.tables = root.rstrip("/"), tables
        self.processor = (retry_seconds, expiry_seconds, forget_after_seconds)

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.root}/events")

    def keyed(self, messages: DataFrame) -> DataFrame:
        """What the keys say about a stream of raw messages and the stream of acks."""
        spark = messages.sparkSession
        parsed = parse(messages, self.tables()[1])
        taken = F.col("reason").isNull()
        bucket = lambda *of: F.pmod(F.xxhash64(*of), F.lit(BUCKETS)).alias("bucket")
        payload = F.to_json(F.coalesce("payload", F.create_map().cast("map<string,string>")))
        fresh = parsed.select(
            F.when(taken, bucket("webhook_id")).otherwise(bucket("raw_body", "signature", "received_at")).alias("bucket"),
            F.when(taken, F.col("webhook_id")).alias("key"),
            F.coalesce("reason", F.lit("message")).alias("kind"),
            "carrier_code",
            "event_type",
            "shipment_reference",
            F.unix_micros("event_timestamp").alias("event_us"),
            payload.alias("payload"),
            F.unix_micros("received_at").alias("received_us"),
            *[F.when(~taken, F.col(c)).alias(c) for c in ("raw_body", "signature")],
            F.lit(None).cast("string").alias("outcome"),
        )
        if not exists(spark, f"{self.root}/acks"):
            spark.createDataFrame([], _ACK).write.parquet(f"{self.root}/acks/batch=-1")
        acks = spark.readStream.schema(f"{_ACK}, batch int").parquet(f"{self.root}/acks")
        blank = [F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in _INPUT.split(", ")[3:-1]]
        told = acks.select(bucket("webhook_id"), F.col("webhook_id").alias("key"), F.lit("ack").alias("kind"), *blank, "outcome")
        return fresh.unionByName(told).groupBy("bucket").transformWithState(Buckets(*self.processor), _OUTPUT, "append", "ProcessingTime")

    def _write(self, df: DataFrame, sink: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{sink}/batch={batch}")

    def __call__(self, said: DataFrame, batch: int) -> None:
        said = said.persist()
        try:
            if said.isEmpty():  # batches run for timers too, mostly none is due
                return
            others, carriers, shipments = self.tables()
            now = F.timestamp_micros("decided_us")
            read = said.filter("status = 'try'").withColumns({"event_timestamp": F.timestamp_micros("event_us"), "received_at": F.timestamp_micros("received_us"), "payload": F.from_json("payload", "map<string,string>")})
            names = ["webhook_id", "carrier_code", "event_type", "shipment_reference", "event_timestamp", "payload", "received_at", "retries", "decided_us"]
            matched = jobs.match_messages(read.select(*names), others, carriers, shipments, now).persist()
            self._write(jobs.message_events(matched, now), "events", batch)
            repeated = said.filter("status = 'already_processed'").select("webhook_id", "carrier_code", "shipment_reference", "status")
            self._write(matched.filter("status NOT IN ('matched', 'retry')").select(*repeated.columns).unionByName(repeated), "closed", batch)
            refused = said.filter("webhook_id IS NULL").select("carrier_code", "raw_body", "signature", F.timestamp_micros("received_us").alias("received_at"), F.col("status").alias("reason"))
            self._write(refused, "quarantine", batch)
            ended = matched.filter("status <> 'retry'").select("webhook_id", F.col("status").alias("outcome"))
            if not ended.isEmpty():
                self._write(ended, "acks", batch)
            matched.unpersist()
        finally:
            said.unpersist()

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run over a stream of raw messages, every second unless told otherwise. A new checkpoint needs an empty root, as in
        :func:`lanewise.streaming.ingest.start`. Timers always ask for another batch, so ``availableNow`` does not end; ``once=True`` does."""
        spark = messages.sparkSession
        if not exists(spark, f"{checkpoint.rstrip('/')}/metadata") and exists(spark, f"{self.root}/events"):
            raise ValueError(f"{self.root} holds the batches of another checkpoint; start with that one or with an empty root")
        writer = self.keyed(messages).writeStream.outputMode("append").foreachBatch(self).option("checkpointLocation", checkpoint)
        with state_store(spark):
            return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
