import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from agoradesk.operators import events, limits, ordered
from agoradesk.operators.chat import admit_messages

T0 = dt.datetime(2024, 1, 1)


def table(spark, rows, schema="k string, id int, ts timestamp"):
    return spark.createDataFrame(rows, schema)


def brute(rows, spec):
    kept, out = {}, {}
    for k, i, ts in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        past = kept.setdefault(k, [])
        ok = all(sum(a >= ts - dt.timedelta(seconds=s) for a in past) < n for s, n in spec)
        out[i] = ok
        past += [ts] if ok else []
    return out


def test_sliding_limit_equals_replay(spark):
    rng = random.Random(1)
    rows, at = [], T0
    for i in range(3000):
        at += dt.timedelta(seconds=rng.choice([0, 1, 1, 2, 30, 30, 600, 4000]) * rng.random())
        rows.append(("hot" if rng.random() < 0.6 else rng.choice("abc"), i, at))
    got = {r.id: r.accepted for r in limits.sliding_limit(table(spark, rows), ["k"], "ts", "id", ((60, 5), (3600, 12))).collect()}
    assert got == brute(rows, ((60, 5), (3600, 12)))


def test_sliding_bounds_are_inclusive(spark):
    rows = [("u", i, T0 + dt.timedelta(seconds=4 * i)) for i in range(15)] + [("u", 15, T0 + dt.timedelta(seconds=60)), ("u", 16, T0 + dt.timedelta(seconds=60.5))]
    got = {r.id: r.accepted for r in limits.sliding_limit(table(spark, rows), ["k"], "ts", "id").collect()}
    assert not got[15] and got[16] and all(got[i] for i in range(15))


def test_duplicates(spark):
    steps = [0, 2, 3, 5, 6.5, 9.6, 20]
    rows = [("u", i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(steps)]
    got = {r.id: r.kept_id for r in limits.suppress_duplicates(table(spark, rows), ["k"], "ts", "id").collect()}
    assert got == {0: "0", 1: "0", 2: "0", 3: "3", 4: "3", 5: "5", 6: "6"}


def test_rejected_attempts_still_count(spark):
    rows = [("d", i, T0 + dt.timedelta(minutes=i)) for i in range(5)]
    df = table(spark, rows).withColumn("ip", F.lit("x"))
    out = {r.id: (r.rejected_by, r.ip_count) for r in limits.tumbling_limits(df, [("device", "k", 3), ("ip", "ip", 2)], F.date_trunc("hour", "ts"), ["ts", "id"]).collect()}
    assert out == {0: (None, 1), 1: (None, 2), 2: ("ip", 3), 3: ("device", None), 4: ("device", None)}
    sat = {r.id: (r.accepted, r.counter) for r in limits.saturating_limit(table(spark, rows), "k", F.date_trunc("hour", "ts"), ["ts"], 3).collect()}
    assert sat[2] == (True, 3) and sat[4] == (False, 3)


def test_message_admission_mixes_limits_and_duplicates(spark):
    rows = [("u", i, T0 + dt.timedelta(seconds=s), f"b{i}") for i, s in enumerate(range(16))]
    rows += [("u", 20, T0 + dt.timedelta(seconds=200), "same"), ("u", 21, T0 + dt.timedelta(seconds=202), "same"), ("u", 22, T0 + dt.timedelta(seconds=203), "same"),
             ("u", 23, T0 + dt.timedelta(seconds=203.5), "same")]
    df = spark.createDataFrame(rows, "user_id string, message_id int, ts timestamp, body string").withColumns(
        {"institution_id": F.lit("h"), "channel_id": F.lit("all"), "reply_to": F.lit(None).cast("long"), "reply_ok": F.lit(True), "check_code": F.lit("ok")})
    got = {r.message_id: r.status_code for r in admit_messages(df, "ts").collect()}
    assert [got[i] for i in range(16)] == ["success"] * 15 + ["rate_limited"]
    assert [got[i] for i in (20, 21, 22, 23)] == ["success", "duplicate_suppressed", "duplicate_suppressed", "success"]


def test_null_keys_and_times_keep_their_rows(spark):
    rows = [(None, i, T0 + dt.timedelta(seconds=i)) for i in range(20)] + [("a", 20, None), ("a", 21, T0), (None, 22, None)]
    got = {r.id: r.accepted for r in limits.sliding_limit(table(spark, rows), ["k"], "ts", "id", ((60, 5), (3600, 12))).collect()}
    assert len(got) == 23 and [got[i] for i in range(20)] == [i < 5 for i in range(20)] and got[20] and got[21] and got[22]
    kept = {r.id: r.kept_id for r in limits.suppress_duplicates(table(spark, rows), ["k"], "ts", "id", 30).collect()}
    assert len(kept) == 23 and all(kept[i] == "0" for i in range(20)) and (kept[20], kept[21], kept[22]) == ("20", "21", "22")


def test_null_keys_in_ordered_columns(spark):
    rows = [(k, i, T0 + dt.timedelta(hours=i)) for i, k in enumerate([None, "a", None, "a", None])]
    df = table(spark, rows)
    hour = F.date_trunc("hour", "ts")
    near = {r.id: (r.before, r.after) for r in ordered.with_neighbours(df, ["k"], ["ts", "id"], hour, {"before": F.col("id")}, {"after": F.col("id")}).collect()}
    assert near == {0: (None, 2), 1: (None, 3), 2: (0, 4), 3: (1, None), 4: (2, None)}
    total = {r.id: r.n for r in ordered.with_running(df, ["k"], ["ts", "id"], hour, {"n": F.lit(1)}).collect()}
    assert total == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}
    last = {r.id: r.v for r in ordered.with_last(df, ["k"], ["ts", "id"], hour, {"v": F.when(F.col("id") < 2, F.col("id"))}).collect()}
    assert last == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0}
    ops = spark.createDataFrame([(None, 1, "x"), (None, 2, "x"), ("o", 3, "x"), ("o", 4, "y")], "op string, at int, body string")
    got = {r.at: r.outcome for r in events.dedupe_operations(ops, ["op"], ["at"], ["body"]).collect()}
    assert got == {1: "first", 2: "first", 3: "first", 4: "idempotency_conflict"}


def test_replay_of_null_long_keys(spark):
    df = spark.createDataFrame([(None, i) for i in range(5)] + [(7, i) for i in range(3)], "k long, i int")

    def start():
        seen = []
        return lambda i: seen.append(i) or len(seen)

    got = sorted(((r.k, r.i, r.n) for r in ordered.replay(df, ["k"], ["i"], start, ["i"], "n", IntegerType()).collect()), key=str)
    assert got == sorted([(None, i, i + 1) for i in range(5)] + [(7, i, i + 1) for i in range(3)], key=str)


def test_screen_counts_without_windows_over_ranges(spark):
    """Ties, null keys and null times; the plan holds no frame that grows with the events of a window."""
    at = [0, 0, 59, 60, 61, 61, 120, 3_600, 3_601, 7_300, None, None]
    rows = [(k, i * 10 + n, None if s is None else T0 + dt.timedelta(seconds=s, microseconds=n % 2)) for i, k in enumerate(("a", None)) for n, s in enumerate(at)]
    out = limits.sliding_screen(spark.createDataFrame(rows, "who string, event_id long, ts timestamp_ntz"), ["who"], "ts", ((60, 2), (3_600, 5)))
    assert "RangeFrame, -" not in out._jdf.queryExecution().executedPlan().toString()
    found = {(r.who, r.event_id, r.ts): (r.within_60s, r.within_3600s, r.may_be_limited) for r in out.collect()}
    for who, event_id, ts in rows:
        near = lambda s: sum(k == who and ((ts is None and t is None) or (ts is not None and t is not None and dt.timedelta(0) <= ts - t <= dt.timedelta(seconds=s))) for k, _, t in rows)  # noqa: B023, E731
        assert found[who, event_id, ts] == (near(60), near(3_600), near(60) > 2 or near(3_600) > 5)


def test_scopes_do_not_repeat_the_ones_before(spark):
    """Each scope reads its rows twice (counts and carried totals), whatever their number."""
    rows = [(i, T0 + dt.timedelta(seconds=i % 90), i % 3, i % 2, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, a int, b int, c int")
    scopes = [("a", "a", 12), ("b", "b", 20), ("c", "c", 4)]
    out = limits.tumbling_limits(df, scopes, F.date_trunc("hour", "ts"), ["ts", "id"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2
    seen, want = {}, {}
    for i, ts, *keys in sorted(rows, key=lambda r: (r[1], r[0])):
        for (name, _, limit), key in zip(scopes, keys):
            seen[name, key] = seen.get((name, key), 0) + 1
            if seen[name, key] > limit:
                want[i] = name
                break
    assert {r.id: r.rejected_by for r in out.where("rejected_by is not null").collect()} == want
