from __future__ import annotations

import json
import time
from datetime import datetime

import pytest
from freight import AS_OF
from pyspark.sql import functions as F

from lanewise.functions import columns as C
from lanewise.functions.signatures import pads, sign, signature_valid, signed
from lanewise.plans import reports
from lanewise.sources.schemas import MESSAGE
from lanewise.streaming import ingest, monitors


def body(webhook: str, reference: str = "S1", **more) -> bytes:
    fields = {"webhook_id": webhook, "event_type": "GATE_OUT", "shipment_reference": reference, "event_timestamp": "2024-03-01T10:00:00Z", "payload": {"a": "b"}}
    return json.dumps({**fields, **more}).encode()


def message(raw: bytes, secret: str = "k", carrier: str = "C1", at: str = "2024-03-01 11:00:00", signature: str | None = None) -> tuple:
    return (carrier, raw, sign(raw, secret) if signature is None else signature, datetime.fromisoformat(at))


@pytest.fixture(scope="module")
def carriers(table):
    return table(
        "carriers",
        {"id": "ca1", "carrier_code": "C1"},
        {"id": "ca2", "carrier_code": "C2", "service_metadata": "{}"},
        {"id": "ca3", "carrier_code": "C3", "is_active": False},
    )


def test_parse_reasons(spark, carriers):
    rows = [
        message(body("ok")),
        message(body("forged"), secret="x"),
        message(body("bare"), signature=sign(body("bare"), "k").removeprefix("sha256=")),
        message(body("none"), signature=""),
        message(body("tampered"), signature=sign(body("other"), "k")),
        message(b"not json"),
        message(body("w" * 129)),
        message(body("")),
        message(body("notime", event_timestamp="soon")),
        message(body("nokey"), carrier="C2"),
        message(body("off"), carrier="C3"),
        message(body("   ")),
        message(body(" padded ", " S1\n")),
    ]
    parsed = ingest.parse(spark.createDataFrame(rows, MESSAGE), carriers)
    got = {bytes(r["raw_body"]): r["reason"] for r in parsed.collect()}
    want = [None, *["bad_signature"] * 4, *["malformed"] * 4, "no_secret", "unknown_carrier", "malformed", None]
    assert got == dict(zip([r[1] for r in rows], want))
    assert sorted((r["webhook_id"], r["shipment_reference"]) for r in ingest.accepted(parsed).collect()) == [("ok", "S1"), ("padded", "S1")]
    assert ingest.quarantined(parsed).count() == 11


def _feed(spark, path, *rows):
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(path)


def test_messages_wait_match_once_and_expire(spark, table, carriers, tmp_path):
    feed, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    others = spark.createDataFrame([("elsewhere",)], "webhook_id string")
    state = {"now": "2024-03-01 11:00:10", "shipments": table("shipments", {"carrier_id": "ca1"})}

    def run(*rows):
        _feed(spark, feed, *rows)
        handler = ingest.Ingest(root, lambda: (others, carriers, state["shipments"]), lambda: C.instant(state["now"]))
        stream = spark.readStream.schema(MESSAGE).parquet(feed)
        ingest.start(stream, handler, checkpoint).awaitTermination()
        return handler

    batch = [message(body("a")), message(body("a")), message(body("b", "S2")), message(body("c", "NEVER")), message(b"junk"), message(body("elsewhere"))]
    handler = run(*batch)
    assert spark.read.parquet(f"{root}/events").count() == 1
    waiting = spark.read.parquet(f"{root}/waiting/batch=0")
    assert {r["webhook_id"] for r in waiting.collect()} == {"b", "c"}

    # replaying the batch writes the same rows over the old ones
    before = sorted(map(str, handler.log(spark).collect()))
    handler(spark.createDataFrame(batch, MESSAGE), 0)
    assert sorted(map(str, handler.log(spark).collect())) == before

    # the shipment arrives, but the first retry is not due yet
    state |= {"now": "2024-03-01 11:00:20", "shipments": table("shipments", {"carrier_id": "ca1"}, {"carrier_id": "ca1"})}
    run(message(body("a"), at="2024-03-01 11:00:15"))
    assert spark.read.parquet(f"{root}/events").count() == 1
    closed = spark.read.parquet(f"{root}/closed").filter("batch = 1").collect()
    assert [(r["webhook_id"], r["status"]) for r in closed] == [("a", "already_processed")]

    state["now"] = "2024-03-01 11:01:00"
    handler = run(message(b"junk", at="2024-03-01 11:00:30"))
    texts = sorted(r["description"] for r in handler.log(spark).collect())
    assert texts == ["Carrier webhook (delayed match): GATE_OUT", "Carrier webhook: GATE_OUT"]

    state["now"] = "2024-03-02 11:00:01"
    handler = run(message(b"junk", at="2024-03-01 11:00:40"))
    closed = spark.read.parquet(f"{root}/closed").filter("batch = 3").collect()
    assert [(r["webhook_id"], r["status"]) for r in closed] == [("c", "expired")]
    assert spark.read.parquet(f"{root}/waiting/batch=3").count() == 0 and handler.log(spark).count() == 2


def test_no_message_is_lost_on_the_default_clock(spark, table, carriers, tmp_path):
    """Waiting messages that fall due while a batch runs are in exactly one sink."""
    root, others = str(tmp_path / "out"), spark.createDataFrame([], "webhook_id string")
    handler = ingest.Ingest(root, lambda: (others, carriers, table("shipments", {"carrier_id": "ca1"})))
    now = datetime.now()
    fresh = [message(body(f"m{k}", "NEVER" if k % 3 else "S1"), at=str(now)) for k in range(60)]
    handler(spark.createDataFrame(fresh, MESSAGE), 0)
    waiting = spark.read.parquet(f"{root}/waiting/batch=0")
    spread = waiting.withColumn("next_try_at", F.current_timestamp() + F.make_dt_interval(secs=F.pmod(F.xxhash64("webhook_id"), F.lit(8000)) / 1000))
    kept = spread.collect()
    spark.createDataFrame(kept, spread.schema).write.mode("overwrite").parquet(f"{root}/waiting/batch=0")
    handler(spark.createDataFrame([message(body("late"), at=str(now))], MESSAGE), 1)
    after = [r["webhook_id"] for r in spark.read.parquet(f"{root}/waiting/batch=1").collect()]
    assert sorted(after) == sorted(f"m{k}" for k in range(60) if k % 3)
    events = spark.read.parquet(f"{root}/events")
    assert events.count() == 21 == events.select("id").distinct().count()
    again = sorted(map(str, spark.read.parquet(f"{root}/waiting/batch=1").collect()))
    handler(spark.createDataFrame([message(body("late"), at=str(now))], MESSAGE), 1)  # a replay has the same instant
    assert sorted(map(str, spark.read.parquet(f"{root}/waiting/batch=1").collect())) == again


def test_new_checkpoint_does_not_replace_old_batches(spark, table, carriers, tmp_path):
    feed, root = str(tmp_path / "in"), str(tmp_path / "out")
    _feed(spark, feed, message(body("a")))
    tables = lambda: (spark.createDataFrame([], "webhook_id string"), carriers, table("shipments", {"carrier_id": "ca1"}))
    stream = lambda: spark.readStream.schema(MESSAGE).parquet(feed)
    handler = ingest.Ingest(root, tables, lambda: C.instant("2024-03-01 11:00:10"))
    ingest.start(stream(), handler, str(tmp_path / "cp")).awaitTermination()
    with pytest.raises(ValueError, match="another checkpoint"):
        ingest.start(stream(), handler, str(tmp_path / "cp2"))
    ingest.start(stream(), handler, str(tmp_path / "cp")).awaitTermination()
    assert handler.log(spark).count() == 1


def test_duplicates_within_a_day_are_dropped(spark, tmp_path):
    feed = str(tmp_path / "in")
    rows = [("w1", datetime(2024, 3, 1, 1)), ("w1", datetime(2024, 3, 1, 2)), ("w2", datetime(2024, 3, 1, 3))]
    spark.createDataFrame(rows, "webhook_id string, received_at timestamp").write.parquet(feed)
    stream = ingest.deduplicated(spark.readStream.schema("webhook_id string, received_at timestamp").parquet(feed))
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["webhook_id"] for r in spark.table("once").collect()) == ["w1", "w2"]


def test_windows_on_a_stream_equal_the_batch(spark, tmp_path):
    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events = base.select(F.pmod("user_id", F.lit(25)).alias("port_id"), F.col("ts").cast("timestamp").alias("event_time"), (F.col("event_type") == "error").alias("is_exception"))
    feed = str(tmp_path / "in")
    events.write.parquet(feed)
    stream = monitors.exception_windows(spark.readStream.schema(events.schema).parquet(feed), "port_id")
    query = stream.writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = monitors.exception_windows(events, "port_id")
    assert spark.table("win").exceptAll(batch).count() == 0 and spark.table("win").count() == batch.count() > 0


def _monitored(spark, table, tmp_path, shipments, *batches):
    log = lambda rows: table("tracking_events", *[{"shipment_id": s, "event_time": t, "is_exception": True} for s, t in rows])
    feed, root = str(tmp_path / "in"), str(tmp_path / "out")
    monitor = monitors.CascadeMonitor(root, lambda: shipments)
    for rows in batches:
        log(rows).coalesce(1).write.mode("append").parquet(feed)
        monitors.start(spark.readStream.schema(log(rows).schema).parquet(feed), monitor, str(tmp_path / "cp")).awaitTermination()
    want = reports.cascades(log([r for rows in batches for r in rows]), shipments, None, 0, 48)
    return monitor, log, sorted(map(str, monitor.totals(spark).collect())), sorted(map(str, want.collect()))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_cascade_monitor_reaches_the_batch_answer(spark, table, tmp_path, monkeypatch, zone):
    """Whatever the driver's zone, with exceptions days apart and with a late event."""
    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        shipments = table("shipments", {"id": "a"}, {"id": "b"}, {"id": "c"})
        first = [("a", "2024-02-10 00:00:00"), ("b", "2024-02-10 23:30:00")]
        second = [("c", "2024-02-11 00:00:00"), ("b", "2024-02-11 12:00:00"), ("a", "2024-02-20 00:00:00"), ("c", "2024-02-21 23:59:00")]
        late = [("c", "2024-02-10 00:30:00"), ("b", "2024-02-22 00:00:00")]
        monitor, log, got, want = _monitored(spark, table, tmp_path, shipments, first, second, late)
        assert got == want and len(got) == 3
        monitor(log(first).filter("false"), 3)  # an empty batch is fine
        monitor(log(second), 1)  # a replay counts what was known then, and its rows stay older ones
        assert sorted(map(str, monitor.totals(spark).collect())) == want
    finally:
        monkeypatch.delenv("TZ")
        time.tzset()


def test_late_events_are_split(table):
    events = table("tracking_events", {"event_time": "2024-02-25", "recorded_at": "2024-02-26"}, {"event_time": "2024-02-25", "recorded_at": "2024-02-26 00:00:01"}, {})
    in_time, late = monitors.split_late(events, 24)
    assert {r["id"] for r in late.collect()} == {"t2"} and in_time.count() == 2
    assert monitors.with_lag(late).first()["lag_seconds"] == 86401


def test_refresh_runs_once_per_new_batch(spark, table, tmp_path):
    feed, calls = str(tmp_path / "in"), []
    events = table("tracking_events", {})
    for _ in range(2):
        events.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(events.schema).parquet(feed)
        monitors.refresh_when_new(stream, lambda: calls.append(AS_OF), str(tmp_path / "cp")).awaitTermination()
    monitors.refresh_when_new(spark.readStream.schema(events.schema).parquet(feed), lambda: calls.append(AS_OF), str(tmp_path / "cp")).awaitTermination()
    assert len(calls) == 2


def test_signatures_equal_the_library_for_any_key_length(spark):
    secrets = ["k", "é" * 20, "x" * 63, "x" * 64, "x" * 65, "long" * 50, ""]
    rows = [(s, b) for s in secrets for b in (b"", b"{}", bytes(range(256)), "ünï".encode())]
    got = spark.createDataFrame(rows, "secret string, body binary").select("secret", "body", signed(F.col("body"), F.col("secret")).alias("s")).collect()
    assert len(got) == len(rows) and all(r["s"] == sign(bytes(r["body"]), r["secret"]) for r in got)
    nulls = spark.createDataFrame([(None, b"a"), ("k", None)], "secret string, body binary")
    valid = signature_valid(F.col("body"), F.lit("sha256=00"), *pads(F.col("secret")))
    assert [r[0] for r in nulls.select(valid).collect()] == [False, False]
