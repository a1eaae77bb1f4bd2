"""Uniqueness over time: at most one active version, open request or published revision at any moment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import micros
from agoradesk.operators.ordered import place_key, with_last, with_running

FOREVER = (1 << 62) - 1


def _ends(rows: DataFrame) -> DataFrame:
    """Both ends of every interval; at one moment ends come before starts, since an interval does not hold its end."""
    started = rows.withColumns({"_at": F.col("_from"), "_kind": F.lit(1)})
    ended = rows.where(F.col("_to") < FOREVER).withColumns({"_at": F.col("_to"), "_kind": F.lit(0)})
    return started.unionByName(ended)


def contested(intervals: DataFrame, keys: list[str], start: str, end: str, row_id: str, grain: int = 86_400) -> DataFrame:
    """Intervals that share a stretch of time with another one of their key: ``intervals`` with _from, _to, _stretch and _until.

    A sweep over the ends counts how many intervals are open; a stretch runs from a moment when none was open to the next such moment. The
    sweep runs in buckets of ``grain`` seconds that hand their counts on, so one key may hold any share of the rows.
    """
    from_, to = micros(F.col(start)), F.coalesce(micros(F.col(end)), F.lit(FOREVER))
    rows = intervals.withColumns({"_from": from_, "_to": to}).where("_from < _to")
    bucket = F.floor(F.col("_at") / (grain * 1_000_000))
    order = ["_at", "_kind", row_id]
    swept = with_running(_ends(rows), keys, order, bucket, {"_open": 2 * F.col("_kind") - 1})
    opens = F.when((F.col("_kind") == 1) & (F.col("_open") == 1), F.col("_at"))
    named = with_last(swept, keys, order, bucket, {"_stretch": opens}).where("_kind = 1").drop("_at", "_kind", "_open")
    busy = named.groupBy(place_key(keys, F.col("_stretch")).alias("_place")).agg(F.count(F.lit(1)).alias("_n"), F.max("_from").alias("_until"))
    held = named.withColumn("_place", place_key(keys, F.col("_stretch")))
    return held.join(busy.where("_n > 1"), "_place").drop("_n", "_place")


def overlap_report(intervals: DataFrame, keys: list[str], start: str, end: str, row_id: str, grain: int = 86_400) -> DataFrame:
    """Every two intervals of a key that hold at one time: the keys, first_id, second_id, overlap_from, overlap_to (null: no end).

    Intervals hold their start but not their end; a null end is open, an interval without a start or of no length overlaps nothing. Null keys
    are equal. Where the data keeps its rule nothing is left after the sweep; what is left is paired within the
    buckets of time that both touch, the later start deciding the bucket, so every pair is found once.
    """
    kind = intervals.schema[start].dataType
    rows = contested(intervals, keys, start, end, row_id, grain).select(
        *keys, F.col(row_id).alias("_id"), "_from", "_to", "_stretch", "_until", F.col(start).alias("_start"), F.col(end).alias("_end"))
    step = grain * 1_000_000
    name = place_key(keys, F.col("_stretch"))
    day = lambda at: F.floor(at / step).cast("long")
    early = rows.select(
        F.explode(F.sequence(day(F.col("_from")), day(F.least(F.col("_to") - 1, F.col("_until"))))).alias("_day"), name.alias("_place"),
        *keys, F.col("_id").alias("first_id"), F.col("_from").alias("_first_from"), F.col("_to").alias("_first_to"), F.col("_end").alias("_first_end"))
    late = rows.select(day(F.col("_from")).alias("_day"), name.alias("_place"), F.col("_id").alias("second_id"), "_from", "_to", F.col("_start").alias("overlap_from"), "_end")
    meets = (F.col("_from") < F.col("_first_to")) & (
        (F.col("_first_from") < F.col("_from")) | ((F.col("_first_from") == F.col("_from")) & (F.col("first_id") < F.col("second_id"))))
    until = F.when(F.col("_to") < F.col("_first_to"), F.col("_end")).otherwise(F.col("_first_end"))
    pairs = early.join(late, ["_place", "_day"]).where(meets)
    return pairs.select(*keys, "first_id", "second_id", "overlap_from", until.cast(kind).alias("overlap_to"))
