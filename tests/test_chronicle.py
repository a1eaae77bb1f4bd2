"""Counters in parts, state as of a time, lifecycles, revision chains, overlaps, many needles and sketches, against plain walks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agoradesk.operators import chat, events, intervals, limits, needles, ordered, reporting, revisions

T0 = dt.datetime(2024, 1, 1)
HOUR = lambda c: F.date_trunc("hour", c)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def spread_out(spark):
    """Without adaptive execution small tables keep their partitions, so that tasks can be counted."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "16")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def tasks(df, column):
    """Partitions that hold rows when ``column`` is computed."""
    return len({r.p for r in df.select(F.spark_partition_id().alias("p"), column).collect()})


def test_a_hot_institution_is_counted_in_many_tasks(spark, spread_out):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.95 else None, f"d{rng.randrange(40)}", i, at(rng.randrange(3_600))) for i in range(4_000)]
    df = spark.createDataFrame(rows, "institution string, device string, id int, ts timestamp")
    out = limits.tumbling_limits(df, [("device", "device", 60), ("institution", "institution", 300)], F.date_trunc("hour", "ts"), ["ts", "id"])
    device, house, want = {}, 0, {}
    for inst, d, i, _ in sorted(rows, key=lambda r: (r[3], r[2])):
        device[d] = device.get(d, 0) + 1
        if device[d] > 60:
            want[i] = (device[d], None, "device")
        elif inst:
            house += 1
            want[i] = (device[d], house, "institution" if house > 300 else None)
        else:
            want[i] = (device[d], None, None)
    assert {r.id: (r.device_count, r.institution_count, r.rejected_by) for r in out.collect()} == want
    assert tasks(out.where("institution = 'hot'"), "institution_count") > 8
    counted = limits.saturating_limit(df, "institution", F.date_trunc("hour", "ts"), ["ts", "id"], 20)
    hot = [r for r in counted.where("institution = 'hot'").collect()]
    assert sum(r.accepted for r in hot) == 20 and max(r.counter for r in hot) == 20
    assert tasks(counted.where("institution = 'hot'"), "counter") > 8


def test_as_of_takes_the_state_at_the_rows_own_time(spark):
    rng = random.Random(2)
    history = [(rng.choice(["a", "b", None]), at(rng.randrange(50_000)), n, f"v{n}") for n in range(60)] + [("a", at(100), 200, "low"), ("a", at(100), 201, "high"), ("a", None, 202, "never")]
    rows = [(rng.choice(["a", "b", "c", None]), i, at(rng.randrange(50_000))) for i in range(300)] + [("a", 900, at(100)), ("a", 901, None)]
    left = spark.createDataFrame(rows, "k string, id int, ts timestamp")
    right = spark.createDataFrame(history, "k string, since timestamp, n int, state string")
    got = {r.id: r.state for r in ordered.as_of(left, right, ["k"], "ts", "since", ["state"], HOUR, "n").collect()}
    want = {}
    for k, i, ts in rows:
        seen = [(s, n, v) for key, s, n, v in history if key == k and s is not None and ts is not None and s <= ts]
        want[i] = max(seen)[2] if seen else None
    assert got == want and got[900] == "high" and got[901] is None


def walk_revisions(rows, base):
    current, out = dict(base), {}
    for s, i, _, expected in sorted(rows, key=lambda r: (r[2], r[1])):
        if s not in current:
            continue
        ok = expected is not None and expected == current[s]
        current[s] += ok
        out[i] = ("saved" if ok else "revision_conflict", current[s])
    return out


def test_revision_chains_equal_the_walk(spark, spread_out):
    rng = random.Random(3)
    rows, level = [], 5
    for i in range(3_000):  # nine tenths on one set, whose chain runs through most of them
        hot = rng.random() < 0.9
        expected = level if rng.random() < 0.7 else level + rng.randrange(-2, 3)
        level += hot and expected == level
        rows.append(("hot" if hot else rng.choice("abc"), i, at(i * 20), expected))
    rows += [("a", 5_000, at(10), None), ("unknown", 5_001, at(10), 5), ("hot", 5_002, at(0), 5), ("hot", 5_003, at(0), 6)]
    ops = spark.createDataFrame(rows, "set_id string, op_id long, ts timestamp, expected_revision long")
    base = {"hot": 5, "a": 1, "b": 7, "c": 5}
    sets = spark.createDataFrame(list(base.items()), "set_id string, revision long")
    out = revisions.revision_conflicts(ops, sets, "set_id", "ts", "op_id")
    got = {r.op_id: (r.status_code, r.current_revision) for r in out.collect()}
    assert got == walk_revisions(rows, base)
    assert max(r for s, r in got.values() if s == "saved") > 1_000
    assert tasks(out.where("set_id = 'hot'"), "current_revision") > 8
    assert revisions.revision_conflicts(ops.limit(0), sets, "set_id", "ts", "op_id").count() == 0


def test_lifecycle_of_versions_equals_the_walk(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["k", "l", None]), rng.randrange(4), i, at(rng.randrange(40_000) // 50 * 50), rng.choice(["activate", "deactivate"])) for i in range(600)]
    acts = spark.createDataFrame(rows, "key string, doc int, id int, ts timestamp, action string")
    state, want = {}, {}
    for key, doc, i, _, action in sorted(rows, key=lambda r: (r[3], r[2])):
        held = state.setdefault(key, {})
        now, gone = held.get(doc, "draft"), None
        if action == "activate":
            code = "already_active" if now == "active" else "activated"
            for other in [d for d, s in held.items() if s == "active" and d != doc]:
                held[other], gone = "obsolete", other
            held[doc] = "active"
        else:
            code = {"active": "deactivated", "inactive": "already_inactive"}.get(now, "document_not_active")
            held[doc] = "inactive" if now == "active" else now
        want[i] = (code, gone)
    got = {r.id: (r.status_code, r.obsoleted) for r in events.document_lifecycle(acts, ["key"], "doc", "ts", "id").collect()}
    assert got == want and len({c for c, _ in want.values()}) == 5


def test_reply_targets(spark):
    sent = spark.createDataFrame([(1, "h", "c", at(0)), (2, "h", "d", at(0)), (3, "g", "c", at(0)), (4, "h", "c", at(90))], "message_id int, institution_id string, channel_id string, created_at timestamp")
    gone = spark.createDataFrame([(1, at(50))], "message_id int, deleted_at timestamp")
    rows = [(10, "h", "c", at(10), None), (11, "h", "c", at(10), 1), (12, "h", "c", at(50), 1), (13, "h", "c", at(10), 2), (14, "h", "c", at(10), 3), (15, "h", "c", at(10), 4), (16, "h", "c", at(95), 4), (17, "h", "c", at(95), 99)]
    msgs = spark.createDataFrame(rows, "message_id int, institution_id string, channel_id string, ts timestamp, reply_to int")
    got = {r.message_id: r.reply_ok for r in chat.reply_targets(msgs, sent, gone, "ts").collect()}
    assert got == {10: True, 11: True, 12: False, 13: False, 14: False, 15: False, 16: True, 17: False}


def test_deletion_takes_reactions_and_refuses_later_ones(spark):
    rows = [(1, 7, "u", "x", at(0)), (2, 7, "u", "x", at(5)), (3, 7, "u", "x", at(6)), (4, 8, "u", "x", at(7)), (5, 8, "u", "x", at(200)), (6, 7, "v", "x", at(300)), (7, 9, "v", "x", at(301))]
    toggles = spark.createDataFrame(rows, "id int, message int, who string, emoji string, ts timestamp")
    gone = spark.createDataFrame([(7, at(100))], "message_id int, deleted_at timestamp")
    out = events.reaction_outcomes(toggles, gone, "message", "who", "emoji", "ts", "id", ((60, 3), (3_600, 100)))
    assert {r.id: r.status_code for r in out.collect()} == {1: "added", 2: "removed", 3: "added", 4: "rate_limited", 5: "added", 6: "message_deleted", 7: "added"}
    left = events.remaining_reactions(out, gone, "message", "who", "emoji")
    assert sorted(tuple(r) for r in left.collect()) == [(8, "x", 1), (9, "x", 1)]


def test_an_author_with_pauses_is_walked_in_parts(spark):
    rows = [("u", i, at(i // 20 * 9_000 + i % 20), f"b{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "user_id string, message_id int, ts timestamp, body string").withColumns(
        {"institution_id": F.lit("h"), "channel_id": F.lit("all"), "reply_to": F.lit(None).cast("long"), "reply_ok": F.lit(True), "check_code": F.lit("ok")})
    got = {r.message_id: r.status_code for r in chat.admit_messages(df, "ts").collect()}
    assert all(got[i] == ("success" if i % 20 < 15 else "rate_limited") for i in range(60))


def test_overlaps_in_time_equal_brute_force(spark, spread_out):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice(["a", None]), i, at(s := rng.randrange(3_000_000)), rng.choice([at(s + rng.randrange(20_000)), at(s), None if i % 40 == 0 else at(s + 500)])) for i in range(400)]
    rows += [("a", 900, None, at(5)), ("z", 901, at(0), at(10)), ("z", 902, at(10), at(20)), ("z", 903, at(0), at(10))]
    df = spark.createDataFrame(rows, "k string, id int, a timestamp, z timestamp")
    end = lambda t: t or dt.datetime(9999, 1, 1)
    good = [r for r in rows if r[2] is not None and r[2] < end(r[3])]
    want = sorted(
        ((x[0], x[1], y[1], y[2], min((x[3], y[3]), key=end)) for x in good for y in good if x[0] == y[0] and (x[2], x[1]) < (y[2], y[1]) and y[2] < end(x[3])), key=str)
    assert sorted((tuple(r) for r in intervals.overlap_report(df, ["k"], "a", "z", "id").collect()), key=str) == want
    assert ("z", 901, 903, at(0), at(10)) in want and not any(902 in r[1:3] for r in want)
    tidy = df.where("k = 'z' and id <> 903")
    assert intervals.overlap_report(tidy, ["k"], "a", "z", "id").count() == 0


def test_many_needles_equal_brute_force(spark):
    rng = random.Random(6)
    signs = ["a", "b", "É", "é", "😀", " ", "ß", "c"]
    text = lambda n: "".join(rng.choice(signs) for _ in range(n))
    rows = [(rng.choice("xy"), i, text(rng.randrange(40))) for i in range(200)] + [("x", 900, None), ("x", 901, "")]
    asked = [(rng.choice("xyz"), i, text(rng.randrange(6))) for i in range(120)] + [("x", 900, None), ("y", 901, "  "), ("x", 902, "É😀"), ("x", 903, "😀"), ("y", 904, "not there at all")]
    got = needles.find_needles(
        spark.createDataFrame(rows, "tenant string, id int, body string"), spark.createDataFrame(asked, "tenant string, q int, needle string"), "tenant", "id", "body", "q", "needle")
    want = sorted((t, i, q) for t, i, b in rows if b is not None for u, q, n in asked if t == u and (n or "").strip(" ").lower() in b.lower())
    assert sorted(tuple(r) for r in got.collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Contains" in plan


def test_merged_sketches_are_within_their_error(spark):
    rng = random.Random(7)
    values = [rng.lognormvariate(5, 2) for _ in range(20_000)]
    log = spark.createDataFrame([("h", i % 50, v) for i, v in enumerate(values)] + [("g", 1, None)], "institution string, hour int, duration_ms double")
    merged = reporting.merge_sketches(reporting.duration_sketches(log, ["institution", "hour"]), ["institution"])
    out = {r.institution: r for r in reporting.sketch_percentiles(merged).collect()}
    assert (out["h"].requests, out["h"].merged) == (20_000, 50)
    for p in (50, 95, 99):
        assert abs(sum(v <= out["h"][f"p{p}"] for v in values) / len(values) - p / 100) < 0.02
    assert out["g"].requests == 1 and out["g"].p50 is None


def test_needles_read_each_text_once(spark):
    """One pass over the rows; short, long, repeated, blank and unheard needles; texts that end inside a gram; a row without a letter."""
    texts = ["abc", "xabcx", "ab", "c", "été à l'école", "ÉTÉ", "", None, "bcab", "a" * 50]
    words = ["ABC", "a", "é", "té", " ", "zzz", "cab", "aaaa", "abc", None, "l'éc"]
    rows = spark.createDataFrame([(k, i, t) for k in (1, 2) for i, t in enumerate(texts)], "k int, id long, t string")
    asked = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)], "k int, n long, w string")
    out = needles.find_needles(rows, asked, "k", "id", "t", "n", "w")
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = sorted((1, i, n) for i, t in enumerate(texts) for n, w in enumerate(words) if t is not None and (w or "").strip(" ").lower() in t.lower())
    assert sorted((r.k, r.id, r.n) for r in out.collect()) == want
