"""State derived from event tables: toggles, marks, pins, requests, versions, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match, is_distinct, labelled
from agoradesk.operators.limits import REACTION_LIMITS, sliding_limit
from agoradesk.operators.ordered import as_of, with_last, with_neighbours, with_running

# Pin durations, request lifetime, text shown for a removed message.
PIN_HOURS = {"1h": 1, "4h": 4, "1j": 24, "3j": 72}
REQUEST_HOURS = 24
REMOVED_PREVIEW = "Message supprimé"
EMOJI = {"👍": "👍", "❤️": "❤️", "❤": "❤️", "😂": "😂"}
CLEARED_STAMPS = ("validated_by", "validated_at", "published_by", "published_at", "archived_at")
EDITORIAL_STEPS = (
    ("draft", "draft"), ("draft", "needs_review"),
    ("needs_review", "draft"), ("needs_review", "needs_review"), ("needs_review", "validated"),
    ("validated", "draft"), ("validated", "validated"), ("validated", "published"), ("validated", "archived"),
    ("published", "published"), ("published", "archived"),
)
EDITORIAL_IGNORED = (
    "status", "active", "display_order", "updated_by", "updated_at", "validated_by", "validated_at",
    "published_by", "published_at", "archived_at",
)


def hour_of(ts: str) -> Column:
    return F.date_trunc("hour", F.col(ts))


def emoji(col: Column) -> Column:
    return labelled(F.trim(col), EMOJI)


def person(user: Column, legacy: Column) -> Column:
    """One identity for rows written before and after internal ids existed."""
    return F.coalesce(user.cast("string"), legacy.cast("string"))


def toggle_state(events: DataFrame, keys: list[str]) -> DataFrame:
    """Reactions that are on after an odd number of toggles."""
    return events.groupBy(*keys).agg(F.count("*").alias("toggles")).withColumn("is_on", F.col("toggles") % 2 == 1)


def toggle_actions(events: DataFrame, keys: list[str], ts: str, event_id: str) -> DataFrame:
    """What each toggle did: added or removed."""
    numbered = with_running(events, keys, [ts, event_id], hour_of(ts), {"_n": F.lit(1)})
    return numbered.withColumn("action", F.when(F.col("_n") % 2 == 1, "added").otherwise("removed")).drop("_n")


def reaction_counts(state: DataFrame, message: list[str], emoji_col: str) -> DataFrame:
    """Emoji → count per message; the set of emoji is closed, so the map is small."""
    counted = state.where("is_on").groupBy(*message, emoji_col).agg(F.count("*").cast("int").alias("total"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(emoji_col), F.col("total"))))
    return counted.groupBy(*message).agg(F.map_from_entries(entries).alias("counts"))


def read_marks(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """High-water mark of reading per person and channel; it never goes back."""
    return events.groupBy(*keys).agg(F.max(ts).alias("last_read_at"))


def last_seen(events: DataFrame, device: str, ts: str) -> DataFrame:
    return events.groupBy(device).agg(F.max(ts).alias("last_seen_at"))


def pin_state(events: DataFrame, channel: list[str], ts: str, event_id: str, now: Column) -> DataFrame:
    """The pin in force per channel.

    ``events`` has ``action`` (pin, unpin, delete), ``message_id`` and
    ``duration``. A pin replaces the one before it; an unpin clears the channel;
    deleting a message clears it only while that message is the pinned one.
    """
    place = F.struct(F.col(ts), F.col(event_id))
    acts = events.where(F.col("action").isin("pin", "unpin"))
    last = acts.groupBy(*channel).agg(
        F.max_by(F.struct("action", "message_id", "duration", F.col(ts).alias("pinned_at"), F.col(event_id).alias("pin_event")), place).alias("p")
    ).select(*channel, "p.*")
    removed = events.where("action = 'delete'").groupBy(*channel, "message_id").agg(F.max(place).alias("_removed"))
    joined = last.join(removed, [*channel, "message_id"], "left")
    hours = labelled(F.col("duration"), PIN_HOURS)
    until = F.col("pinned_at") + F.make_dt_interval(hours=hours)
    cleared = F.coalesce(F.col("_removed") > F.struct(F.col("pinned_at"), F.col("pin_event")), F.lit(False))
    out = joined.withColumn("pinned_until", until)
    live = (F.col("action") == "pin") & ~cleared & (F.col("pinned_until") > now)
    return out.withColumn("pinned", F.coalesce(live, F.lit(False))).drop("_removed", "pin_event")


def request_state(requests: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Status of activation requests (``request_id, device_id, created_at``).

    The first of a decision (``request_id, decision, decided_at``), the next
    request of the same device and the end of the lifetime settles a request.
    """
    chained = with_neighbours(
        requests, ["device_id"], ["created_at", "request_id"], hour_of("created_at"), lead={"next_at": F.col("created_at")}
    )
    first = decisions.groupBy("request_id").agg(
        F.min_by("decision", "decided_at").alias("decision"), F.min("decided_at").alias("decided_at")
    )
    expires = F.col("created_at") + F.make_dt_interval(hours=F.lit(REQUEST_HOURS))
    rows = chained.withColumn("expires_at", expires).join(first, "request_id", "left")
    open_at = F.coalesce(F.least(F.col("next_at"), F.col("expires_at")), F.col("expires_at"))
    decided = (F.col("decided_at") < open_at) & (F.col("decided_at") <= now)
    superseded = (F.col("next_at") < F.col("expires_at")) & (F.col("next_at") <= now)
    status = F.when(decided, F.col("decision")).when(superseded, "cancelled").when(F.col("expires_at") <= now, "expired")
    reason = F.when(decided, "decided").when(superseded, "superseded_by_new_request").when(F.col("expires_at") <= now, "automatic_expiration")
    return rows.withColumn("status", F.coalesce(status, F.lit("pending"))).withColumn("reason", reason).drop("next_at", "decision")


def message_state(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Messages after their edits and deletions, and the previews shown in replies.

    ``messages``: message_id, channel, body, reply_to; ``edits``: message_id,
    at, action (edit, delete), body. Edits after the deletion are ignored.
    """
    gone = edits.where("action = 'delete'").groupBy("message_id").agg(F.min("at").alias("deleted_at"))
    live = edits.where("action = 'edit'").join(gone, "message_id", "left").where("deleted_at is null or at < deleted_at")
    last = live.groupBy("message_id").agg(F.max_by("body", "at").alias("new_body"), F.max("at").alias("edited_at"))
    now = messages.join(last, "message_id", "left").join(gone, "message_id", "left")
    deleted = F.col("deleted_at").isNotNull()
    state = now.select(
        *[c for c in messages.columns if c != "body"],
        F.when(deleted, "").otherwise(F.coalesce("new_body", "body")).alias("body"),
        (F.col("new_body").isNotNull() & ~deleted).alias("edited"),
        deleted.alias("deleted"),
    )
    parent = state.select(
        F.col("message_id").alias("reply_to"),
        F.when(F.col("deleted"), F.lit(REMOVED_PREVIEW)).otherwise(F.col("body")).alias("reply_preview"),
    )
    return state.join(parent, "reply_to", "left")


def document_versions(activations: DataFrame, keys: list[str], ts: str, version: str, bucket: Column | None = None) -> DataFrame:
    """Validity interval of each activated version; the next activation of the key ends it."""
    spans = with_neighbours(
        activations, keys, [ts, version], hour_of(ts) if bucket is None else bucket, lead={"valid_to": F.col(ts), "replaced_by": F.col(version)}
    )
    return spans.withColumn("valid_from", F.col(ts)).withColumn(
        "status", F.when(F.col("valid_to").isNull(), "active").otherwise("obsolete")
    )


def document_lifecycle(acts: DataFrame, keys: list[str], document: str, ts: str, event_id: str) -> DataFrame:
    """Outcome of every ``action`` (activate, deactivate) on the versions of a document key.

    Activating a version makes the active one of its key obsolete; a deactivated version is inactive and may be activated again. Adds
    ``status_code`` (activated, already_active, deactivated, already_inactive, document_not_active) and ``obsoleted``, the version an activation
    replaced. ``event_id`` is unique and orders actions of one time. A key of any length is settled in buckets of time.
    """
    order, hour = [ts, event_id], hour_of(ts)
    place = F.struct(F.col(document).alias("doc"), F.col(event_id).alias("event"))
    starts = F.col("action") == "activate"
    seen = with_last(acts.where(F.col("action").isin("activate", "deactivate")), keys, order, hour, {"_live": F.when(starts, place)})
    own = F.coalesce(F.col("_live")["doc"] == F.col(document), F.lit(False))
    # the first deactivation of the version that the last activation made active takes effect
    ended = seen.where(~starts & own).groupBy(F.col("_live")["event"].alias("_activation")).agg(F.min(F.struct(*order)).alias("_end"))
    ended = ended.select("_activation", F.col("_end")[event_id].alias("_ended_by"))
    made = with_neighbours(seen.where(starts).drop("_live"), keys, order, hour, lag={"_prior": place}).withColumn("_activation", F.col("_prior")["event"])
    made = made.join(ended, "_activation", "left")
    still = F.col("_prior").isNotNull() & F.col("_ended_by").isNull()
    same = F.col("_prior")["doc"] == F.col(document)
    activated = made.withColumns({
        "status_code": F.when(still & same, "already_active").otherwise("activated"), "obsoleted": F.when(still & ~same, F.col("_prior")["doc"]),
    }).select(*acts.columns, "status_code", "obsoleted")
    stops = seen.where(~starts).withColumn("_activation", F.col("_live")["event"]).join(ended, "_activation", "left")
    effective = own & (F.col("_ended_by") == F.col(event_id))
    stops = stops.withColumn("_now", F.when(F.coalesce(effective, F.lit(False)), "deactivated").when(own, "already_inactive"))
    history = activated.select(*keys, document, *order, F.lit("active").alias("_state")).unionByName(
        stops.where("_now = 'deactivated'").select(*keys, document, *order, F.lit("inactive").alias("_state"))
    ).withColumnsRenamed({ts: "_since", event_id: "_tie"})
    bare = stops.select(*acts.columns, "_now")
    judged = as_of(bare, history, [*keys, document], ts, "_since", ["_state"], lambda c: F.date_trunc("hour", c), "_tie", event_id)
    code = F.coalesce("_now", F.when(F.col("_state") == "inactive", "already_inactive").otherwise("document_not_active"))
    stopped = judged.withColumns({"status_code": code, "obsoleted": F.lit(None).cast(acts.schema[document].dataType)})
    return activated.unionByName(stopped.select(*acts.columns, "status_code", "obsoleted"))


def deleted_then(rows: DataFrame, deletions: DataFrame, message: str, ts: str) -> DataFrame:
    """``rows`` with ``target_deleted``: whether the message they name had been deleted at their time.

    ``deletions`` has message_id and deleted_at. A message of any fame is many tasks: both sides meet in hours.
    """
    gone = deletions.select(F.col("message_id").alias(message), F.col("deleted_at").alias("_since"), F.lit(True).alias("target_deleted"))
    found = as_of(rows, gone, [message], ts, "_since", ["target_deleted"], lambda c: F.date_trunc("hour", c))
    return found.withColumn("target_deleted", F.coalesce("target_deleted", F.lit(False)))


def reaction_outcomes(
    toggles: DataFrame, deletions: DataFrame, message: str, user: str, emoji_col: str, ts: str, event_id: str, limits=REACTION_LIMITS
) -> DataFrame:
    """``status_code`` of every toggle: message_deleted, rate_limited, added or removed.

    A deletion takes a message's reactions with it and refuses later ones; of the others only those count that the user's limits let
    through, and each of these flips the reaction.
    """
    known = deleted_then(toggles, deletions, message, ts)
    refused = known.where("target_deleted").withColumn("status_code", F.lit("message_deleted"))
    judged = sliding_limit(known.where("not target_deleted"), [user], ts, event_id, limits)
    slow = judged.where("not accepted").withColumn("status_code", F.lit("rate_limited")).drop("accepted")
    done = toggle_actions(judged.where("accepted").drop("accepted"), [message, user, emoji_col], ts, event_id).withColumnRenamed("action", "status_code")
    columns = [*toggles.columns, "status_code"]
    return refused.select(*columns).unionByName(slow.select(*columns)).unionByName(done.select(*columns))


def remaining_reactions(outcomes: DataFrame, deletions: DataFrame, message: str, user: str, emoji_col: str) -> DataFrame:
    """Reactions that are on after all outcomes, per message and emoji; a deleted message has none."""
    on = toggle_state(outcomes.where("status_code in ('added', 'removed')"), [message, user, emoji_col]).where("is_on")
    kept = on.join(deletions.select(F.col("message_id").alias(message)).distinct(), message, "left_anti")
    return kept.groupBy(message, emoji_col).agg(F.count(F.lit(1)).alias("total"))


def illegal_transitions(
    history: DataFrame, keys: list[str], order: list[str], bucket: Column, status: str = "status", allowed=EDITORIAL_STEPS
) -> DataFrame:
    """Status changes outside the allowed pairs; a first version must be a draft."""
    moved = with_neighbours(history, keys, order, bucket, lag={"from_status": F.col(status)})
    pair = F.concat_ws(">", F.coalesce("from_status", F.lit("")), F.col(status))
    legal = [f"{a}>{b}" for a, b in allowed] + [">draft"]
    return moved.where(~pair.isin(*legal))


def immutable_changes(
    history: DataFrame, keys: list[str], order: list[str], bucket: Column, ignore: tuple[str, ...] = EDITORIAL_IGNORED,
    protected: tuple[str, ...] = ("validated", "published"), status: str = "status",
) -> DataFrame:
    """Versions that changed a business column while their predecessor was protected, or followed an archived one."""
    business = [c for c in history.columns if c not in {*ignore, *order}]
    seen = with_neighbours(
        history, keys, order, bucket,
        lag={"from_status": F.col(status), "_was": F.xxhash64(*business)},
    ).withColumn("_is", F.xxhash64(*business))
    changed = F.col("from_status").isin(*protected) & is_distinct(F.col("_was"), F.col("_is"))
    back_to_draft = (F.col("from_status") == "validated") & (F.col(status) == "draft") & ~is_distinct(F.col("_was"), F.col("_is"))
    broken = (changed & ~back_to_draft) | (F.col("from_status") == "archived")
    return seen.where(broken).drop("_was", "_is")


def apply_editorial(df: DataFrame, old_status: str, now: Column, status: str = "status") -> DataFrame:
    """Stamps that follow a status change: a return to drafting clears them, archiving deactivates."""
    reopened = F.col(status).isin("draft", "needs_review") & is_distinct(F.col(old_status), F.col(status))
    archived = (F.col(status) == "archived") & is_distinct(F.col(old_status), F.lit("archived"))
    out = df.withColumns({c: F.when(~reopened, F.col(c)) for c in CLEARED_STAMPS if c in df.columns})
    return out.withColumns(
        {
            "active": F.when(archived, F.lit(False)).otherwise(F.col("active")),
            "archived_at": F.when(archived, F.coalesce(F.col("archived_at"), now)).otherwise(F.col("archived_at")),
            "updated_at": now,
        }
    )


def dedupe_operations(ops: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Replays of an operation id: first, replayed (same payload) or idempotency_conflict; without an id each operation is a first one."""
    firsts = ops.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("_first"), F.min(F.struct(*order)).alias("_at")
    )
    joined = ops.join(firsts, keys, "left")
    outcome = (
        F.when(F.col("_at").isNull() | (F.struct(*order) == F.col("_at")), "first")
        .when(F.struct(*payload).eqNullSafe(F.col("_first")), "replayed")
        .otherwise("idempotency_conflict")
    )
    return joined.withColumn("outcome", outcome).drop("_first", "_at")


def token_state(now: Column) -> Column:
    """State of a presented token row (null row: unknown), in order of precedence."""
    return first_match(
        (F.col("token_id").isNull(), "token_not_found"),
        (F.col("consumed_at").isNotNull(), "token_already_consumed"),
        (F.col("invalidated_at").isNotNull(), "token_invalidated"),
        (F.col("token_expires_at") <= now, "token_expired"),
        default="valid",
    )


def classify_tokens(attempts: DataFrame, tokens: DataFrame, now: Column) -> DataFrame:
    return attempts.join(tokens, ["token_hash", "method"], "left").withColumn("token_state", token_state(now))


def apply_activations(attempts: DataFrame, tokens: DataFrame, order: list[str]) -> DataFrame:
    """First valid use of a token binds the device; later uses find it consumed.

    The clock of each attempt is its own time (``order[0]``).
    """
    judged = classify_tokens(attempts, tokens, F.col(order[0]))
    winners = judged.where("token_state = 'valid'").groupBy("token_id").agg(F.min(F.struct(*order)).alias("_won"))
    out = judged.join(winners, "token_id", "left")
    status = (
        F.when(F.col("token_state") != "valid", F.col("token_state"))
        .when(F.struct(*order) == F.col("_won"), "success")
        .otherwise("token_already_consumed")
    )
    return out.withColumn("status_code", status).drop("_won")


