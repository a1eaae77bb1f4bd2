"""Streaming forms of the counters and marks: event-time windows with a stated watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Our choice, since the rules themselves know no lateness: rows later than this are not counted.
LATENESS = "10 minutes"


def _timed(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness)


def tumbling_counts(stream: DataFrame, key: str, ts: str, window: str, limit: int, lateness: str = LATENESS) -> DataFrame:
    """Attempts per key and epoch-aligned window, and how many went over the limit."""
    counted = _timed(stream, ts, lateness).groupBy(F.window(ts, window), key).agg(F.count("*").alias("attempts"))
    return counted.select(
        F.col("window.start").alias("window_start"), key, "attempts", F.greatest(F.col("attempts") - limit, F.lit(0)).alias("rejected")
    )


def high_water_marks(stream: DataFrame, keys: list[str], ts: str, name: str) -> DataFrame:
    """Latest time per key (read marks, last seen); one long per key is kept, in update mode."""
    return stream.groupBy(*keys).agg(F.max(ts).alias(name))


def toggle_states(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each reaction is on, in update mode."""
    return stream.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("is_on"))


def latest_pins(stream: DataFrame, channel: list[str], ts: str, event_id: str) -> DataFrame:
    """Last pin or unpin per channel, in update mode; expiry is applied when it is read."""
    acts = stream.where(F.col("action").isin("pin", "unpin"))
    last = F.max_by(F.struct("action", "message_id", "duration", F.col(ts).alias("pinned_at")), F.struct(F.col(ts), F.col(event_id)))
    return acts.groupBy(*channel).agg(last.alias("p")).select(*channel, "p.*")


def first_operations(stream: DataFrame, keys: list[str], ts: str, lateness: str = "1 hour") -> DataFrame:
    """Each operation id once within the lateness; replays are dropped."""
    return _timed(stream, ts, lateness).dropDuplicatesWithinWatermark(keys)
