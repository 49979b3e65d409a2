"""Keyed ingest: tries, retries by timer, expiry, restarts from state."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_streaming import body, message

from lanewise.sources.schemas import MESSAGE
from lanewise.streaming.keyed_ingest import BUCKETS, Buckets, KeyedIngest, Retries


@pytest.fixture(scope="module")
def carriers(table):
    return table("carriers", {"id": "ca1", "carrier_code": "C1"}, {"id": "ca3", "carrier_code": "C3", "is_active": False})


def feed(spark, path, *rows):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(path)


def until(condition, query, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if condition():
            return
        time.sleep(0.3)
    raise AssertionError("not in time")


def rows_in(spark, path):
    try:
        return spark.read.parquet(path).collect()
    except Exception:  # nothing was written yet
        return []


def test_retries_expiry_and_restart(spark, table, carriers, tmp_path):
    path, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    state = {"shipments": table("shipments", {"carrier_id": "ca1"})}
    others = spark.createDataFrame([("elsewhere",)], "webhook_id string")
    ingest = KeyedIngest(root, lambda: (others, carriers, state["shipments"]), retry_seconds=1.0)
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    at, old = str(now), str(now - timedelta(hours=25))
    feed(spark, path, message(body("a"), at=at), message(body("a"), at=at), message(body("b", "S2"), at=at), message(body("gone", "NEVER"), at=old), message(b"junk", at=at), message(body("elsewhere"), at=at))
    stream = lambda: spark.readStream.schema(MESSAGE).parquet(path)
    query = ingest.start(stream(), checkpoint, processingTime="200 milliseconds")
    try:
        until(lambda: len(rows_in(spark, f"{root}/closed")) == 3, query)
        assert [r["description"] for r in rows_in(spark, f"{root}/events")] == ["Carrier webhook: GATE_OUT"]
        closed = sorted((r["webhook_id"], r["status"]) for r in rows_in(spark, f"{root}/closed"))
        assert closed == [("a", "already_processed"), ("elsewhere", "already_processed"), ("gone", "expired")]
        assert [(r["reason"], bytes(r["raw_body"])) for r in rows_in(spark, f"{root}/quarantine")] == [("malformed", b"junk")]
    finally:
        query.stop()

    # what waits and what is recorded survives the restart; the shipment has come meanwhile
    state["shipments"] = table("shipments", {"carrier_id": "ca1"}, {"carrier_id": "ca1"})
    feed(spark, path, message(body("a"), at=at), message(body("b", "S2"), at=at), message(body("gone", "S1"), at=at), message(body("off"), carrier="C3", at=at))
    query = ingest.start(stream(), checkpoint, processingTime="200 milliseconds")
    try:
        until(lambda: len(rows_in(spark, f"{root}/events")) == 3, query)
        time.sleep(2)
    finally:
        query.stop()
    events = spark.read.parquet(f"{root}/events")
    got = {r["webhook_id"]: (r["description"], r["retries"]) for r in events.select(F.get_json_object("raw_payload", "$.webhook_id").alias("webhook_id"), "description", F.get_json_object("raw_payload", "$.retries").cast("int").alias("retries")).collect()}
    assert events.count() == 3 and got["a"] == ("Carrier webhook: GATE_OUT", None) and got["gone"] == ("Carrier webhook: GATE_OUT", None)
    assert got["b"][0] == "Carrier webhook (delayed match): GATE_OUT" and got["b"][1] >= 1
    closed = sorted((r["webhook_id"], r["status"]) for r in rows_in(spark, f"{root}/closed"))
    assert closed[:2] == [("a", "already_processed")] * 2 and ("b", "already_processed") in closed
    assert sorted(r["reason"] for r in rows_in(spark, f"{root}/quarantine")) == ["malformed", "unknown_carrier"]
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest.start(stream(), str(tmp_path / "cp2"))




def test_a_key_works_on_rows_with_few_calls_of_its_state():
    calls = []

    class State:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def update(self, value):
            calls.append("update")
            self.value = value

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append(("timer", at))

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 5_000

    names = "key kind carrier_code event_type shipment_reference event_us payload received_us raw_body signature outcome".split()
    sent = lambda us, code: Row(*names)("w", "message", code, "GATE", "S1", 1, "{}", us, b"", "", None)
    state = Retries(30, 3600, None)
    state.init(Handle())
    said = list(state.handleInputRows(("w",), iter([sent(2, "B"), sent(1, "Z"), sent(1, None), sent(1, "A")]), Clock()))
    assert [(r.carrier_code, r.status) for r in said] == [("A", "try"), ("Z", "already_processed"), (None, "already_processed"), ("B", "already_processed")]
    assert calls == ["exists", "exists", "update", ("timer", 35_000)]


class Store:
    """What Spark keeps for one bucket: the waiting messages, the recorded ids, the timers; and the calls made for them."""

    def __init__(self):
        self.value, self.known, self.timers, self.calls = None, set(), set(), 0

    def _called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, *_):
        return self

    getMapState = getValueState
    get = lambda self: self._called(self.value)
    update = lambda self, value: self._called(setattr(self, "value", value))
    clear = lambda self: self._called(setattr(self, "value", None))
    exists = lambda self: self._called(bool(self.known))
    containsKey = lambda self, key: self._called(key in self.known)
    updateValue = lambda self, key, _: self._called(self.known.add(key))
    registerTimer = lambda self, at: self._called(self.timers.add(at))
    deleteTimer = lambda self, at: self._called(self.timers.remove(at))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def incoming(key, kind="message", us=1, outcome=None, raw=None):
    names = "bucket key kind carrier_code event_type shipment_reference event_us payload received_us raw_body signature outcome".split()
    return Row(*names)(7, key, kind, "C", "GATE", "S1", 1, '{"é": "\\""}', us, raw, None, outcome)


def test_ids_of_a_bucket_cost_one_read_and_one_write_and_each_has_its_own_state():
    store = Store()

    def batch(ms, *rows):
        state = Buckets(30, 3600, None)  # each batch has a processor of its own; only the store stays
        state.init(store)
        said = list(state.handleInputRows((7,), iter(rows), Clock(ms)))
        return sorted((str(r.webhook_id), r.status, r.retries) for r in said)

    many = [f"w{n}" for n in range(500)]
    said = batch(1_000_000, *[incoming(w, us=us) for us in (1_000_000_000, 999_000_000) for w in many], incoming(None, "malformed", raw=b"junk"))
    assert said == sorted([(w, status, 0) for w in many for status in ("try", "already_processed")] + [("None", "malformed", 0)])
    assert store.timers == {1_030_000} and store.calls <= 5
    assert batch(1_001_000, incoming("w0", "ack", outcome="matched"), incoming("w1", "ack", outcome="expired"), incoming("w2", "ack", outcome="retry")) == []
    assert batch(1_002_000, *[incoming(w, us=1_002_000_000) for w in ("w0", "w1", "w2")]) == [("w0", "already_processed", 0), ("w1", "try", 0), ("w2", "already_processed", 0)]
    assert store.known == {("w0",)} and store.timers == {1_030_000, 1_032_000}

    def fired(ms, at):
        state = Buckets(30, 3600, None)
        state.init(store)
        said = [(r.webhook_id, r.status, r.retries, r.payload) for r in state.handleExpiredTimer((7,), Clock(ms), None)]
        store.timers.remove(at)  # Spark's part
        return said

    again = fired(1_031_000, 1_030_000)
    assert sorted(again) == sorted((w, "try", 1, '{"é": "\\""}') for w in many if w not in ("w0", "w1"))
    assert fired(1_040_000, 1_032_000) == [("w1", "try", 1, '{"é": "\\""}')] and store.timers == {1_091_000, 1_100_000}
    batch(1_041_000, *[incoming(w, "ack", outcome="expired") for w in many])
    assert store.value is None and store.timers == set() and store.known == {("w0",)}


def test_the_stream_is_grouped_by_buckets_of_ids(spark, carriers, table, tmp_path):
    feed(spark, str(tmp_path / "in"), message(body("a"), at="2024-03-01"))
    ingest = KeyedIngest(str(tmp_path / "out"), lambda: (spark.createDataFrame([], "webhook_id string"), carriers, table("shipments", {})))
    said = ingest.keyed(spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "in")))
    plan = said._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "pmod(xxhash64(webhook_id" in plan and f"{BUCKETS}" in plan
