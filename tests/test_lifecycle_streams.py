"""Streams with timers against the batch operators, over a restart. They take minutes, so they run only if STREAM_TESTS is set."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from agoradesk.operators import events as ev
from agoradesk.session import shared_dir
from agoradesk.streaming import lifecycles

T0 = dt.datetime(2024, 1, 1)
pytestmark = pytest.mark.skipif(not os.environ.get("STREAM_TESTS"), reason="STREAM_TESTS is not set")


@pytest.fixture(autouse=True)
def rocksdb(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(n) for n in names]
    lifecycles.use_rocksdb(spark)
    spark.conf.set(names[1], "2")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def twice(spark, tmp_path, name, rows, schema, build):
    """Rows of the stream's output: the first half is run, the query stopped, the rest added and the query started again."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        query = build(source).writeStream.format("parquet").option("path", out).trigger(availableNow=True).option(
            "checkpointLocation", shared_dir(spark, "lifecycles", name)).start()
        query.awaitTermination(180)
        assert query.exception() is None
    return spark.read.parquet(out)


def test_requests_equal_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows, at, asked = [], T0, []
    for i in range(120):
        at += dt.timedelta(minutes=rng.randrange(20, 300))
        if rng.random() < 0.6 or not asked:
            device = rng.choice("abc")
            asked.append((i, device))
            rows.append((device, i, i, at, None))
        else:
            request, device = rng.choice(asked[-4:])
            rows.append((device, request, i, at, rng.choice(["approved", "cancelled"])))
    end = at + dt.timedelta(days=9)
    rows.append(("z", 999, 999, end, None))  # carries the watermark past every expiry
    rows.append(("z", 1000, 1000, end + dt.timedelta(seconds=1), None))
    schema = "device_id string, request_id long, event_id long, ts timestamp, decision string"
    out = twice(spark, tmp_path, "requests", rows, schema, lambda s: lifecycles.request_stream(s, "ts"))
    last = out.where("status <> 'refused' and device_id <> 'z'").groupBy("request_id").agg(F.max_by(F.struct("status", "reason"), F.struct("at", F.col("status") != "pending")).alias("s"))
    got = {r.request_id: (r.status, r.reason) for r in last.select("request_id", "s.*").collect()}
    df = spark.createDataFrame(rows, schema).where("device_id <> 'z'")
    requests = df.where("decision is null").select("request_id", "device_id", F.col("ts").alias("created_at"))
    decisions = df.where("decision is not null").select("request_id", "decision", F.col("ts").alias("decided_at"))
    state = ev.request_state(requests, decisions, F.lit(end))
    assert got == {r.request_id: (r.status, r.reason) for r in state.collect()}
    assert {s for s, _ in got.values()} == {"approved", "cancelled", "expired"}
    assert out.where("status = 'refused'").count() > 0


def test_pins_equal_batch_over_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows, at = [], T0
    for i in range(120):
        at += dt.timedelta(minutes=rng.randrange(5, 200))
        rows.append((rng.choice("abc"), rng.randrange(4), i, at, rng.choice(["pin", "pin", "unpin", "delete"]), rng.choice(["1h", "4h", "1j"])))
    rows.append(("z", 0, 998, at, "unpin", None))
    rows.append(("z", 0, 999, at + dt.timedelta(seconds=1), "unpin", None))
    schema = "channel string, message_id long, event_id long, ts timestamp, action string, duration string"
    out = twice(spark, tmp_path, "pins", rows, schema, lambda s: lifecycles.pin_stream(s, "ts"))
    last = {r.channel: (r.message_id, r.state == "pinned") for r in out.groupBy("channel").agg(
        F.max_by("message_id", F.struct("at", F.col("state") == "pinned")).alias("message_id"), F.max_by("state", F.struct("at", F.col("state") == "pinned")).alias("state")).collect()}
    now = at + dt.timedelta(seconds=1)
    batch = ev.pin_state(spark.createDataFrame(rows, schema).where("channel <> 'z'"), ["channel"], "ts", "event_id", F.lit(now))
    for r in batch.collect():
        assert not r.pinned or last[r.channel] == (r.message_id, True)
        assert r.pinned or not last[r.channel][1] or r.pinned_until is None or r.pinned_until >= at - dt.timedelta(minutes=10)
    assert {r.state for r in out.select("state").distinct().collect()} >= {"pinned", "replaced", "unpinned", "expired", "message_deleted"}


def test_replays_get_the_first_result_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), f"o{rng.randrange(25)}", i, T0 + dt.timedelta(seconds=i), rng.choice(["save", "save", "drop"]), f"result {i}") for i in range(160)]
    schema = "tenant string, operation_id string, event_id long, ts timestamp, payload string, result string"
    out = twice(spark, tmp_path, "operations", rows, schema, lambda s: lifecycles.operation_stream(s, "ts"))
    batch = ev.dedupe_operations(spark.createDataFrame(rows, schema), ["tenant", "operation_id"], ["ts", "event_id"], ["payload"])
    assert {r.event_id: r.outcome for r in out.collect()} == {r.event_id: r.outcome for r in batch.collect()}
    first = {(t, o): res for t, o, _, _, _, res in reversed(rows)}
    assert all(r.result == (None if r.outcome == "idempotency_conflict" else first[r.tenant, r.operation_id]) for r in out.collect())
