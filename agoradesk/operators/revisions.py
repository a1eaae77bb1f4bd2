"""Optimistic revisions of whole operation tables, without walking a set's operations one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import micros
from agoradesk.operators.ordered import with_last, with_running
from agoradesk.session import staged


def next_holders(ops: DataFrame, key: str, at: str, op_id: str, grain: int = 3_600) -> DataFrame:
    """(op, next): for each operation the first later one of its set that expects the revision the former would make.

    Operations and the searches for them meet in one table ordered backwards in time; ``grain`` seconds are one bucket, so neither a set
    nor an expected revision is bound to one task.
    """
    level, place = F.col("expected_revision"), micros(F.col(at))
    base = ops.where("expected_revision is not null").select(F.col(key).alias("_set"), level.alias("_level"), (-place).alias("_back"), F.col(op_id).alias("_op"))
    held = base.withColumns({"_side": F.lit(0), "_holder": F.col("_op")})
    asks = base.withColumns({"_level": F.col("_level") + 1, "_side": F.lit(1), "_holder": F.lit(None).cast("long")})
    both = held.unionByName(asks).withColumn("_back_op", -F.col("_op"))
    bucket = F.floor(F.col("_back") / (grain * 1_000_000))
    found = with_last(both, ["_set", "_level"], ["_back", "_back_op", "_side"], bucket, {"_next": F.col("_holder")})
    return found.where("_side = 1 and _next is not null").select(F.col("_op").alias("op"), F.col("_next").alias("next"))


def reachable(starts: DataFrame, jumps: DataFrame) -> DataFrame:
    """(op) of all operations that chains from ``starts`` (op) pass, each step given by ``jumps`` (op, next).

    Pointer doubling: round i adds what lies 2^i steps on and squares the jumps, so a chain of n operations takes log2(n) rounds of joins.
    The rows of the rounds are disjoint, as every operation has one next and at most one chain passes it.
    """
    jumps, found = staged(jumps, "jumps"), staged(starts.select("op"), "reached")
    while True:
        step = staged(found.join(jumps, "op").select(F.col("next").alias("op")), "step")
        if step.isEmpty():
            return found
        found = staged(found.unionByName(step), "reached")
        onward = jumps.select(F.col("op").alias("next"), F.col("next").alias("far"))
        jumps = staged(jumps.join(onward, "next").select("op", F.col("far").alias("next")), "jumps")


def revision_conflicts(ops: DataFrame, sets: DataFrame, key: str, at: str, op_id: str) -> DataFrame:
    """Each operation ``saved`` with the set's new revision, or ``revision_conflict`` with the current one.

    ``ops`` has ``expected_revision`` and a whole-number ``op_id`` that orders operations of one time; ``sets`` has the starting
    ``revision``. An operation is accepted when it expects the current revision, and moves it on by one: the accepted ones of a set are the
    chain that leads from the first that expects the starting revision, always to the next that expects one more. An operation
    without an expected revision meets a conflict; operations of unknown sets are left out.
    """
    joined = ops.join(sets.select(key, F.col("revision").alias("_base")), key)
    place = F.struct(F.col(at), F.col(op_id))
    first = joined.where("expected_revision = _base").groupBy(key).agg(F.min(place).alias("_first"))
    accepted = reachable(first.select(F.col("_first")[op_id].alias("op")), next_holders(joined, key, at, op_id))
    marked = joined.join(accepted.select(F.col("op").alias(op_id), F.lit(1).alias("_saved")), op_id, "left")
    hour = F.floor(micros(F.col(at)) / 3_600_000_000)
    counted = with_running(marked, [key], [at, op_id], hour, {"_made": F.coalesce("_saved", F.lit(0))})
    status = F.when(F.col("_saved").isNotNull(), "saved").otherwise("revision_conflict")
    current = (F.col("_base") + F.col("_made")).cast("long")
    return counted.withColumns({"status_code": status, "current_revision": current, "revision": F.col("_base")}).drop("_base", "_saved", "_made")
