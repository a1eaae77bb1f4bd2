"""Rate limits and duplicate suppression over whole event tables."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from agoradesk.functions.columns import micros
from agoradesk.operators.ordered import place_key, replay, with_last, with_neighbours, with_running
from agoradesk.session import staged

# Limits per scope, in the order they are tested.
REQUEST_SCOPES = (("device", 3), ("ip", 30), ("institution", 300))
ACTIVATION_SCOPES = (("device", 5), ("token", 10), ("ip", 20))
MESSAGE_LIMITS = ((60, 15), (3_600, 120))
REACTION_LIMITS = ((60, 60), (3_600, 500))
UPLOADS_PER_HOUR = 20
DUPLICATE_SECONDS = 3


def _grain(order: list[str], seconds: int) -> Column:
    """Part of the window that a row falls in; rows are numbered inside parts and the parts' counts are carried on."""
    return F.floor(micros(F.col(order[0])) / (seconds * 1_000_000))


def tumbling_limits(
    attempts: DataFrame, scopes: list[tuple[str, str, int]], window: Column, order: list[str], grain: int = 60
) -> DataFrame:
    """Count attempts per scope and fixed window, rejected ones included.

    ``scopes`` holds (name, key column, limit). Scopes are tested in order and
    only attempts the earlier ones let through are counted by the later ones.
    ``order`` begins with the time of the attempt. A window is counted in parts
    of ``grain`` seconds, one small count per part is carried to the next
    ones, so a key that holds most of an hour is as many tasks as the hour
    has parts. A scope's verdicts are stored before the next one counts: it
    reads its rows twice, and each scope would else double the work before it.
    """
    out = attempts.withColumns({"_window": window, "_part": _grain(order, grain), "rejected_by": F.lit(None).cast("string")})
    for place, (name, key, limit) in enumerate(scopes):
        if place:
            out = staged(out, "attempts")
        passed = F.col("rejected_by").isNull() & F.col(key).isNotNull()
        out = with_running(out, [key, "_window"], order, F.col("_part"), {"_n": passed.cast("int")})
        out = out.withColumn(f"{name}_count", F.when(passed, F.col("_n")).cast("int")).drop("_n")
        out = out.withColumn(
            "rejected_by", F.coalesce("rejected_by", F.when(F.col(f"{name}_count") > limit, F.lit(name)))
        )
    return out.withColumnRenamed("_window", "window_start").drop("_part")


def saturating_limit(
    df: DataFrame, key: str, window: Column, order: list[str], limit: int = UPLOADS_PER_HOUR, grain: int = 60
) -> DataFrame:
    """A counter that stops at its limit: later rows are refused and leave it unchanged. Counted in parts, as above."""
    rows = df.withColumn("window_start", window)
    numbered = with_running(rows, [key, "window_start"], order, _grain(order, grain), {"_n": F.lit(1)})
    return numbered.withColumns(
        {"accepted": F.col("_n") <= limit, "counter": F.least("_n", F.lit(limit)).cast("int")}
    ).drop("_n")


def _sliding_walker(limits: tuple[tuple[int, int], ...]):
    longest = max(seconds for seconds, _ in limits) * 1_000_000

    def start():
        accepted: deque[int] = deque()

        def step(at: int) -> bool:
            while accepted and accepted[0] < at - longest:
                accepted.popleft()
            for seconds, limit in limits:
                if sum(1 for a in accepted if a >= at - seconds * 1_000_000) >= limit:
                    return False
            accepted.append(at)
            return True

        return step

    return start


def sliding_limit(
    events: DataFrame,
    keys: list[str],
    ts: str,
    event_id: str,
    limits: tuple[tuple[int, int], ...] = MESSAGE_LIMITS,
) -> DataFrame:
    """Add ``accepted``: fewer than each limit of *accepted* events in the trailing window, bounds inclusive.

    Most hours cannot reach any limit and are settled without looking at their
    order: when an hour and the one before hold no more events than the
    smallest limit, all are accepted. Only runs of busy hours, with the
    preceding hour as context, are walked in order.
    """
    longest = max(seconds for seconds, _ in limits)
    smallest = min(limit for _, limit in limits)
    rows = events.withColumn("_at", micros(F.col(ts))).withColumn("_slot", F.floor(F.col("_at") / (longest * 1_000_000)))
    per_slot = rows.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy(*keys).orderBy("_slot")
    adjacent = F.lag("_slot").over(by_key) == F.col("_slot") - 1
    slots = per_slot.withColumn("_busy", F.col("_n") + F.when(adjacent, F.lag("_n").over(by_key)).otherwise(0) > smallest)
    follows = F.lead("_slot").over(by_key) == F.col("_slot") + 1
    context = ~F.col("_busy") & follows & F.coalesce(F.lead("_busy").over(by_key), F.lit(False))
    slots = slots.withColumn("_walk", F.col("_slot").isNotNull() & (F.col("_busy") | context))
    # A new run begins at a context slot, after a gap, or after a slot nobody walks.
    begins = ~F.col("_busy") | ~F.coalesce(adjacent, F.lit(False)) | ~F.coalesce(F.lag("_walk").over(by_key), F.lit(False))
    slots = slots.withColumn("_run", F.max(F.when(begins, F.col("_slot"))).over(by_key)).select(place_key(keys, F.col("_slot")).alias("_place"), "_walk", "_run")
    placed = rows.withColumn("_place", place_key(keys, F.col("_slot"))).join(slots, "_place").drop("_place")
    calm = placed.where(~F.col("_walk")).withColumn("accepted", F.lit(True))
    walked = replay(
        placed.where("_walk"), [*keys, "_run"], ["_at", event_id], _sliding_walker(limits), ["_at"], "accepted", BooleanType()
    )
    return calm.unionByName(walked).drop("_at", "_slot", "_walk", "_run")


def sliding_screen(events: DataFrame, keys: list[str], ts: str, limits: tuple[tuple[int, int], ...] = MESSAGE_LIMITS) -> DataFrame:
    """Upper bound without state: events that *could* be over a limit, counting all earlier events.

    An event's window holds as many events as there are up to its time less those before the window opens. Both are running counts over
    the distinct times of a key and the times at which their windows open, taken in parts of a minute: the work does not grow with
    the events a window holds, and a key with most of the events is as many tasks as its time has minutes.
    """
    out = events.withColumns({"_at": micros(F.col(ts)), "_spot": place_key(keys, micros(F.col(ts)).alias("at"))})
    times = out.groupBy("_spot").agg(F.count("*").alias("_new"))
    opens = [F.struct((F.col("_spot")["at"] - s * 1_000_000).alias("at"), F.lit(s).alias("s"), F.lit(0).cast("long").alias("n")) for s, _ in limits]
    marks = times.select("_spot", F.inline(F.array(F.struct(F.col("_spot")["at"].alias("at"), F.lit(0).alias("s"), F.col("_new").alias("n")), *opens)))
    held = [f"_k{i}" for i in range(len(keys))]
    marks = marks.withColumns({k: F.col("_spot")[f"k{i}"] for i, k in enumerate(held)})
    # At one time a window opens before the events of that time are counted.
    counted = with_running(marks, held, ["at", F.desc("s")], F.floor(F.col("at") / 60_000_000), {"_upto": F.col("n")})
    known = lambda s: F.max(F.when(F.col("s") == s, F.col("_upto")))
    within = counted.groupBy("_spot").agg(*[(known(0) - known(s)).alias(f"within_{s}s") for s, _ in limits])
    out = out.join(within, "_spot").drop("_spot")
    over = F.greatest(*[(F.col(f"within_{s}s") > n).cast("int") for s, n in limits]) == 1
    return out.withColumn("may_be_limited", over).drop("_at")


def _duplicate_walker(micro_gap: int):
    def start():
        anchor: list = [None, None]

        def step(at: int, event_id: object) -> str:
            if anchor[0] is None or anchor[0] < at - micro_gap:
                anchor[0], anchor[1] = at, event_id
            return str(anchor[1])

        return step

    return start


def suppress_duplicates(
    events: DataFrame, keys: list[str], ts: str, event_id: str, seconds: int = DUPLICATE_SECONDS
) -> DataFrame:
    """Add ``kept_id``: the earlier equal event within ``seconds``, or the event itself.

    Equal events closer than the gap form a burst. A burst no longer than the
    gap collapses to its first event; only longer ones are walked in order.
    Null keys are equal; an event without a time is its own.
    """
    gap = seconds * 1_000_000
    rows = events.withColumn("_at", micros(F.col(ts)))
    minute = F.floor(F.col("_at") / 60_000_000)
    near = with_neighbours(rows, keys, ["_at", event_id], minute, lag={"_before_at": F.col("_at")})
    opens = F.col("_before_at").isNull() | (F.col("_before_at") < F.col("_at") - gap)
    first = F.when(opens & F.col("_at").isNotNull(), F.struct(F.col("_at").alias("at"), F.col(event_id).cast("string").alias("id")))
    burst = with_last(near, keys, ["_at", event_id], minute, {"_burst": first})
    timed = F.when(F.col("_at").isNotNull(), F.col("_burst"))
    burst = burst.withColumns({"_from": timed["at"], "_first": timed["id"]}).drop("_burst", "_before_at")
    spans = burst.groupBy(*keys, "_from").agg((F.max("_at") - F.col("_from") > gap).alias("_long"))
    spans = spans.select(place_key(keys, F.col("_from")).alias("_place"), F.coalesce("_long", F.lit(False)).alias("_long"))
    placed = burst.withColumn("_place", place_key(keys, F.col("_from"))).join(spans, "_place").drop("_place")
    short = placed.where(~F.col("_long")).withColumn("kept_id", F.coalesce("_first", F.col(event_id).cast("string")))
    walked = replay(
        placed.where("_long"), [*keys, "_from"], ["_at", event_id], _duplicate_walker(gap), ["_at", event_id], "kept_id", StringType()
    )
    return short.unionByName(walked).drop("_at", "_from", "_first", "_long")
