"""Lifecycles that end by themselves: requests, pins and operation ids as streams with timers and expiring state.

Each processor keeps a few named state values per key. Event-time timers fire once the watermark passes them, also when the key gets no more
rows; what is only remembered to answer latecomers is forgotten after a stated time, by a timer or, where no timers are needed, by the
state's own time to live (which Spark offers with processing time only). Rows of one trigger are put in the order of
time, then of id. The state store must be RocksDB, which :func:`use_rocksdb` sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from agoradesk.functions.columns import micros
from agoradesk.operators.events import PIN_HOURS, REQUEST_HOURS
from agoradesk.streaming.windows import LATENESS

HOUR = 3_600_000_000
LIFETIME = REQUEST_HOURS * HOUR
#: How long settled requests (in event time) and first operations (in processing time) are remembered, in milliseconds.
REMEMBER_MS = 7 * 24 * 3_600_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _prepared(stream: DataFrame, ts: str, lateness: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness).withColumn("at_micros", micros(F.col(ts)))


def _ordered(batches: Iterable[pd.DataFrame]) -> Iterator:
    some = [batch for batch in batches if len(batch)]
    if not some:  # a trigger may bring nothing but a new watermark
        return iter(())
    rows = pd.concat(some).sort_values(["at_micros", "event_id"])
    return rows.astype(object).where(rows.notna(), None).itertuples(index=False)


def _millis(at: int) -> int:
    """The first whole millisecond at or after a time in microseconds."""
    return -(-at // 1_000)


class _Requests(StatefulProcessor):
    """One open request per device: decided, replaced by the next one, or ended by its timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "request_id bigint, created bigint")
        self.settled = handle.getMapState("settled", "request_id bigint", "status string, forget bigint")

    def _settle(self, out: list, key: tuple, status: str, reason: str, at: int) -> None:
        request, created = self.open.get()
        self.open.clear()
        self.handle.deleteTimer(_millis(created + LIFETIME))
        forget = _millis(at) + REMEMBER_MS
        self.settled.updateValue((request,), (status, forget))
        self.handle.registerTimer(forget)
        out.append((key[0], request, status, reason, at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in _ordered(rows):
            at = int(row.at_micros)
            if self.open.exists() and at >= self.open.get()[1] + LIFETIME:
                self._settle(out, key, "expired", "automatic_expiration", self.open.get()[1] + LIFETIME)
            if row.decision is None:
                if self.open.exists():
                    self._settle(out, key, "cancelled", "superseded_by_new_request", at)
                self.open.update((int(row.request_id), at))
                self.handle.registerTimer(_millis(at + LIFETIME))
                out.append((key[0], int(row.request_id), "pending", None, at))
            elif self.open.exists() and self.open.get()[0] == row.request_id:
                self._settle(out, key, row.decision, "decided", at)
            else:
                known = self.settled.getValue((int(row.request_id),)) if self.settled.containsKey((int(row.request_id),)) else ("unknown",)
                out.append((key[0], int(row.request_id), "refused", f"already_{known[0]}", at))
        yield pd.DataFrame(out, columns=["device_id", "request_id", "status", "reason", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.open.exists() and _millis(self.open.get()[1] + LIFETIME) <= expiredTimerInfo.getExpiryTimeInMs():
            self._settle(out, key, "expired", "automatic_expiration", self.open.get()[1] + LIFETIME)
        for request, (_, forget) in list(self.settled.iterator()):
            if forget <= expiredTimerInfo.getExpiryTimeInMs():
                self.settled.removeKey(request)
        yield pd.DataFrame(out, columns=["device_id", "request_id", "status", "reason", "at"])


def request_stream(stream: DataFrame, ts: str, lateness: str = LATENESS) -> DataFrame:
    """Every change of a request's status: device_id, request_id, status, reason, at (microseconds).

    ``stream``: device_id, request_id, event_id, ``ts`` and ``decision``, null for a new request. A decision on a request that is no longer open is
    ``refused``, with the status it has.
    """
    kind = dict(stream.dtypes)["device_id"]
    return _prepared(stream, ts, lateness).groupBy("device_id").transformWithStateInPandas(
        _Requests(), f"device_id {kind}, request_id bigint, status string, reason string, at bigint", "Append", "EventTime"
    )


class _Pins(StatefulProcessor):
    """The pin in force of a channel; it ends by an unpin, the deletion of its message, another pin, or its timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pin = handle.getValueState("pin", "message_id bigint, until bigint")

    def _end(self, out: list, key: tuple, state: str, at: int) -> None:
        message, until = self.pin.get()
        self.pin.clear()
        self.handle.deleteTimer(_millis(until))
        out.append((key[0], message, state, at))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in _ordered(rows):
            at = int(row.at_micros)
            if self.pin.exists() and at >= self.pin.get()[1]:
                self._end(out, key, "expired", self.pin.get()[1])
            held = self.pin.get()[0] if self.pin.exists() else None
            if row.action == "pin" and row.duration in PIN_HOURS:
                if held is not None:
                    self._end(out, key, "replaced", at)
                until = at + PIN_HOURS[row.duration] * HOUR
                self.pin.update((int(row.message_id), until))
                self.handle.registerTimer(_millis(until))
                out.append((key[0], int(row.message_id), "pinned", at))
            elif held is not None and (row.action == "unpin" or (row.action == "delete" and held == row.message_id)):
                self._end(out, key, "unpinned" if row.action == "unpin" else "message_deleted", at)
        yield pd.DataFrame(out, columns=["channel", "message_id", "state", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.pin.exists() and _millis(self.pin.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self._end(out, key, "expired", self.pin.get()[1])
        yield pd.DataFrame(out, columns=["channel", "message_id", "state", "at"])


def pin_stream(stream: DataFrame, ts: str, lateness: str = LATENESS) -> DataFrame:
    """Every change of a channel's pin: channel, message_id, state, at (microseconds). A pin of an unknown duration changes nothing.

    ``stream``: channel, message_id, event_id, action (pin, unpin, delete), duration, ``ts``.
    """
    kind = dict(stream.dtypes)["channel"]
    return _prepared(stream, ts, lateness).groupBy("channel").transformWithStateInPandas(
        _Pins(), f"channel {kind}, message_id bigint, state string, at bigint", "Append", "EventTime"
    )


class _Operations(StatefulProcessor):
    """The first payload and result of an operation id; replays get the result again until it is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "payload string, result string", ttlDurationMs=REMEMBER_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for row in _ordered(rows):
            if not self.first.exists():
                self.first.update((row.payload, row.result))
                out.append((*key, int(row.event_id), "first", row.result))
                continue
            payload, result = self.first.get()
            same = payload == row.payload
            out.append((*key, int(row.event_id), "replayed" if same else "idempotency_conflict", result if same else None))
        yield pd.DataFrame(out, columns=["tenant", "operation_id", "event_id", "outcome", "result"])


def operation_stream(stream: DataFrame, ts: str, lateness: str = LATENESS) -> DataFrame:
    """tenant, operation_id, event_id, outcome, result: a replay of an operation gets the first result, another payload is a conflict.

    ``stream``: tenant, operation_id, event_id, payload, result (what the operation gives where it is the first), ``ts``.
    """
    kinds = dict(stream.dtypes)
    schema = f"tenant {kinds['tenant']}, operation_id {kinds['operation_id']}, event_id bigint, outcome string, result string"
    return _prepared(stream, ts, lateness).groupBy("tenant", "operation_id").transformWithStateInPandas(_Operations(), schema, "Append", "ProcessingTime")
