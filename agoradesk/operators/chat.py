"""Admission of chat messages and of actions on them."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from agoradesk.functions.columns import first_match, is_distinct, micros
from agoradesk.functions.text import normalize_newlines
from agoradesk.operators.access import MANAGER_CHANNEL, open_memberships
from agoradesk.operators.events import PIN_HOURS, deleted_then
from agoradesk.operators.limits import DUPLICATE_SECONDS, MESSAGE_LIMITS
from agoradesk.operators.ordered import replay, with_last, with_neighbours

MAX_CHANNEL, MAX_BODY = 100, 4_000


def _identity(rows: DataFrame, devices: DataFrame, users: DataFrame) -> DataFrame:
    held = devices.select("device_id", F.col("user_id").alias("_user_id"), "activated_at", "revoked_at", F.lit(True).alias("_device"))
    people = users.select(F.col("user_id").alias("_user_id"), "institution_id", F.col("active").alias("_active"), F.lit(True).alias("_user"))
    return rows.join(held, "device_id", "left").join(people, "_user_id", "left")


def _identity_codes() -> list[tuple[Column, str]]:
    return [
        (F.col("_device").isNull(), "device_unknown"),
        (F.col("revoked_at").isNotNull(), "device_revoked"),
        (F.col("activated_at").isNull() | F.col("_user_id").isNull(), "device_not_activated"),
        (F.col("_user").isNull(), "user_unknown"),
        (~F.coalesce("_active", F.lit(False)), "user_inactive"),
    ]


def clean_body(col: Column) -> Column:
    return F.trim(normalize_newlines(F.coalesce(col, F.lit(""))))


def reply_targets(msgs: DataFrame, messages: DataFrame, deletions: DataFrame, ts: str) -> DataFrame:
    """``msgs`` with ``reply_ok``: there is no reply target, or it can be answered at the message's time.

    A target can be answered when it stands in the same institution and channel, was sent before, and is not deleted by then. ``messages``:
    message_id, institution_id, channel_id, created_at; ``deletions``: message_id, deleted_at.
    """
    plain = msgs.where("reply_to is null").withColumn("reply_ok", F.lit(True))
    target = messages.select(F.col("message_id").alias("reply_to"), "institution_id", "channel_id", F.col("created_at").alias("_sent"))
    answers = msgs.where("reply_to is not null").join(target, ["reply_to", "institution_id", "channel_id"], "left")
    known = deleted_then(answers, deletions, "reply_to", ts)
    ok = F.coalesce((F.col("_sent") <= F.col(ts)) & ~F.col("target_deleted"), F.lit(False))
    return plain.unionByName(known.withColumn("reply_ok", ok).select(*msgs.columns, "reply_ok"))


def classify_messages(msgs: DataFrame, devices: DataFrame, users: DataFrame, channels: DataFrame, memberships: DataFrame) -> DataFrame:
    """Stateless part of admission: the first failing check of each message, or ``ok``.

    msgs: message_id, device_id, channel_id, body, reply_to (id or null), reply_ok (target readable).
    """
    rows = msgs.withColumns({"channel_id": F.lower(F.trim(F.coalesce("channel_id", F.lit("")))), "body": clean_body(F.col("body"))})
    rows = _identity(rows, devices, users)
    offered = channels.select("institution_id", "channel_id", F.col("enabled").alias("_enabled"))
    member = memberships.select(F.col("user_id").alias("_user_id"), "institution_id", "channel_id", F.lit(True).alias("_member"))
    rows = rows.join(offered, ["institution_id", "channel_id"], "left").join(member, ["_user_id", "institution_id", "channel_id"], "left")
    code = first_match(
        (~F.length("channel_id").between(1, MAX_CHANNEL), "invalid_channel"),
        (F.length("body") < 1, "empty_message"),
        (F.length("body") > MAX_BODY, "message_too_long"),
        *_identity_codes(),
        (F.col("_enabled").isNull(), "channel_unknown"),
        (~F.col("_enabled"), "channel_disabled"),
        (F.col("_member").isNull(), "channel_access_denied"),
        default="ok",
    )
    return rows.withColumn("check_code", code).withColumnRenamed("_user_id", "user_id").drop(
        "_device", "_user", "_active", "_enabled", "_member", "activated_at", "revoked_at"
    )


def _admission_walker():
    """Serial part for one author: limits count admitted messages, repeats collapse onto a recent equal one."""
    admitted: deque[tuple[int, str, object]] = deque()
    longest = max(s for s, _ in MESSAGE_LIMITS) * 1_000_000

    def step(at: int, signature: str, reply_ok: bool, message_id: object) -> str:
        while admitted and admitted[0][0] < at - longest:
            admitted.popleft()
        if any(sum(1 for a in admitted if a[0] >= at - s * 1_000_000) >= n for s, n in MESSAGE_LIMITS):
            return "rate_limited"
        if not reply_ok:
            return "reply_message_unavailable"
        twins = [a for a in admitted if a[0] >= at - DUPLICATE_SECONDS * 1_000_000 and a[1] == signature]
        if twins:
            return f"duplicate_suppressed:{twins[-1][2]}"
        admitted.append((at, signature, message_id))
        return "success"

    return step


def admit_messages(checked: DataFrame, ts: str) -> DataFrame:
    """Final status of checked messages, walking each author's messages in order.

    Only messages that passed the stateless checks are walked, and only their
    time and a signature of their content travel to the walk. A pause longer
    than the longest limit forgets all that came before, so an author's
    history is as many walks as it has pauses.
    """
    passed = checked.where("check_code = 'ok'")
    signature = F.sha2(F.concat_ws("\x1f", "channel_id", "body", F.coalesce(F.col("reply_to").cast("string"), F.lit("∅"))), 256)
    lean = passed.select("institution_id", "user_id", "message_id", micros(F.col(ts)).alias("_at"), signature.alias("_sig"),
                         F.coalesce("reply_ok", F.lit(True)).alias("_reply_ok"))
    author, order, longest = ["institution_id", "user_id"], ["_at", "message_id"], max(s for s, _ in MESSAGE_LIMITS) * 1_000_000
    part = F.floor(F.col("_at") / longest)
    near = with_neighbours(lean, author, order, part, lag={"_earlier": F.col("_at")})
    opens = F.coalesce(F.col("_earlier") < F.col("_at") - longest, F.lit(True))
    runs = with_last(near, author, order, part, {"_run": F.when(opens, F.col("_at"))}).drop("_earlier")
    walked = replay(runs, [*author, "_run"], order, _admission_walker, ["_at", "_sig", "_reply_ok", "message_id"], "_outcome", StringType())
    parts = F.split("_outcome", ":")
    done = walked.select("message_id", parts[0].alias("status_code"), F.get(parts, F.lit(1)).alias("duplicate_of"))
    refused = checked.where("check_code <> 'ok'").select("message_id", F.col("check_code").alias("status_code"), F.lit(None).cast("string").alias("duplicate_of"))
    return done.unionByName(refused)


def classify_actions(actions: DataFrame, messages: DataFrame, devices: DataFrame, users: DataFrame, channels: DataFrame, memberships: DataFrame) -> DataFrame:
    """Edits, deletions, pins and unpins: the first failing check, or the effect.

    actions: action_id, device_id, action, message_id, body, duration;
    messages: message_id, institution_id, channel_id, author_id, body, deleted, pinned.
    """
    rows = _identity(actions, devices, users)
    target = messages.select(
        "message_id", "institution_id", "channel_id", F.col("author_id").alias("_author"), F.col("body").alias("_old"),
        F.col("deleted").alias("_deleted"), F.col("pinned").alias("_pinned"), F.lit(True).alias("_message"))
    rows = rows.join(target, ["message_id", "institution_id"], "left")
    allowed = open_memberships(memberships, channels)
    reader = allowed.select(F.col("user_id").alias("_user_id"), "institution_id", "channel_id", F.lit(True).alias("_reader"))
    manager = allowed.where(F.col("channel_id") == MANAGER_CHANNEL).select(F.col("user_id").alias("_user_id"), "institution_id", F.lit(True).alias("_manager")).distinct()
    rows = rows.join(reader, ["_user_id", "institution_id", "channel_id"], "left").join(manager, ["_user_id", "institution_id"], "left")
    a = F.col("action")
    pins, edits = a.isin("pin", "unpin"), a.isin("edit", "delete")
    code = first_match(
        ((a == "pin") & ~F.coalesce(F.trim("duration").isin(*PIN_HOURS), F.lit(False)), "invalid_duration"),
        *_identity_codes(),
        (pins & F.col("_manager").isNull(), "cadre_required"),
        (F.col("_message").isNull(), "message_not_found"),
        (edits & is_distinct(F.col("_author"), F.col("_user_id")), "not_message_author"),
        ((a == "delete") & F.col("_deleted"), "already_deleted"),
        (a.isin("edit", "pin") & F.col("_deleted"), "message_deleted"),
        (F.col("_reader").isNull(), "channel_access_denied"),
        ((a == "edit") & (F.col("_old") == clean_body(F.col("body"))), "unchanged"),
        ((a == "unpin") & ~F.col("_pinned"), "already_unpinned"),
        default="success",
    )
    return rows.withColumn("status_code", code).drop(*[c for c in rows.columns if c.startswith("_")], "activated_at", "revoked_at")
