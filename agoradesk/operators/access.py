"""Who may see what: devices, users, channels, roles, tokens and access windows.

No side is hinted as broadcast. Dimension tables below the optimizer's size
threshold are broadcast by it, larger ones are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match, labelled
from agoradesk.operators.ordered import latest_per_key

# Roles and the display rank of channels.
ROLES = ("cadre", "admin", "admin_readonly")
MANAGER_CHANNEL = "cadres"
CHANNEL_RANK = {
    "all": 0, "cadres": 1, "soins": 2, "intendance": 3, "animation": 4, "cuisine": 5, "administration": 6,
    "technique": 7, "cerisiers": 8, "codi": 9,
}
MAX_CHANNELS = 50


def active_users(users: DataFrame, institutions: DataFrame) -> DataFrame:
    live = institutions.where("active").select("institution_id")
    return users.where("active").join(live, "institution_id", "left_semi")


def active_devices(devices: DataFrame, users: DataFrame, institutions: DataFrame) -> DataFrame:
    """Activated, not revoked devices of active users of active institutions."""
    held = devices.where("user_id is not null and activated_at is not null and revoked_at is null")
    owner = active_users(users, institutions).select("user_id", "institution_id")
    return held.join(owner, "user_id")


def open_memberships(memberships: DataFrame, channels: DataFrame) -> DataFrame:
    """Memberships of enabled channels of the same institution."""
    enabled = channels.where("enabled").select("institution_id", "channel_id")
    return memberships.join(enabled, ["institution_id", "channel_id"], "left_semi")


def visible_channels(devices: DataFrame, memberships: DataFrame, channels: DataFrame) -> DataFrame:
    """(device, institution, channel) triples an active device may read."""
    return devices.select("device_id", "user_id", "institution_id").join(
        open_memberships(memberships, channels), ["user_id", "institution_id"]
    )


def visible_rows(df: DataFrame, users: DataFrame, memberships: DataFrame, channels: DataFrame) -> DataFrame:
    """Rows of (user_id, institution_id, channel_id, …) the user is allowed to read."""
    allowed = open_memberships(memberships, channels)
    seen = df.join(allowed, ["user_id", "institution_id", "channel_id"], "left_semi")
    return seen.join(users.select("user_id", "institution_id"), ["user_id", "institution_id"], "left_semi")


def with_role(users: DataFrame, roles: DataFrame, role: str) -> DataFrame:
    """Users holding ``role``; an unknown role matches nobody."""
    held = roles.where((F.col("role") == role) & F.col("role").isin(*ROLES)).select("user_id")
    return users.join(held, "user_id", "left_semi")


def own_rows(df: DataFrame, devices: DataFrame) -> DataFrame:
    """Rows whose user owns an active device."""
    return df.join(devices.select("user_id"), "user_id", "left_semi")


def channel_rank(col: Column) -> Column:
    return F.coalesce(labelled(col, CHANNEL_RANK), F.lit(100))


def classify_access(devices: DataFrame, requests: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """State of every known or requesting device, first match wins."""
    pending = requests.where((F.col("status") == "pending") & (F.col("expires_at") > now))
    last = latest_per_key(pending, ["device_id"], ["created_at", "request_id"]).select(
        "device_id", F.col("request_id").alias("pending_request_id")
    )
    asked = requests.select("device_id").distinct()
    known = devices.withColumn("_known", F.lit(True))
    rows = known.join(asked, "device_id", "full_outer").join(last, "device_id", "left")
    people = users.select("user_id", F.col("active").alias("_user_active"), F.lit(True).alias("_user"))
    rows = rows.join(people, "user_id", "left")
    waiting = F.col("pending_request_id").isNotNull()
    unbound = F.col("_known").isNull() | F.col("activated_at").isNull() | F.col("user_id").isNull()
    state = first_match(
        (F.col("revoked_at").isNotNull(), "device_revoked"),
        (unbound & waiting, "pending_activation"),
        (unbound, "activation_required"),
        (F.col("_user").isNull(), "user_unknown"),
        (~F.coalesce("_user_active", F.lit(False)), "user_inactive"),
        default="active",
    )
    return rows.withColumn("access_state", state).drop("_known", "_user", "_user_active")


def active_access(access: DataFrame, now: Column) -> DataFrame:
    return access.where(F.col("revoked_at").isNull() & (F.col("granted_at") <= now) & (F.col("expires_at") > now))


def clean_channels(df: DataFrame, key: str, channels: DataFrame) -> DataFrame:
    """Trimmed distinct selection with the mandatory ``all``, and its status code.

    ``df`` has ``institution_id`` and an array ``channel_ids``.
    """
    trimmed = F.filter(F.transform("channel_ids", lambda c: F.trim(c)), lambda c: c != "")
    picked = df.withColumn("channel_ids", F.array_sort(F.array_union(F.array_distinct(trimmed), F.array(F.lit("all")))))
    wanted = picked.select(key, "institution_id", F.explode("channel_ids").alias("channel_id"))
    enabled = channels.where("enabled").select("institution_id", "channel_id")
    unknown = wanted.join(enabled, ["institution_id", "channel_id"], "left_anti").groupBy(key).agg(F.count("*").alias("invalid_channels"))
    out = picked.join(unknown, key, "left").withColumn("invalid_channels", F.coalesce("invalid_channels", F.lit(0)))
    status = first_match(
        (F.size("channel_ids") > MAX_CHANNELS, "too_many_channels"),
        (F.col("invalid_channels") > 0, "invalid_channel_selection"),
        default="ok",
    )
    return out.withColumn("status_code", status)


def classify_user_match(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Match of an approved request (``request_id, institution_id, existing_user_id, external_id``)."""
    person = users.select(
        F.col("user_id").alias("existing_user_id"), "institution_id", F.col("active").alias("_active"),
        F.col("external_id").alias("_held"), F.lit(True).alias("_found"),
    )
    holder = users.where("external_id is not null").groupBy("institution_id", "external_id").agg(F.min("user_id").alias("_holder"))
    rows = requests.join(person, ["existing_user_id", "institution_id"], "left").join(holder, ["institution_id", "external_id"], "left")
    fresh = F.col("existing_user_id").isNull()
    given = F.col("external_id").isNotNull()
    taken = given & F.col("_holder").isNotNull()
    status = first_match(
        (fresh & taken, "external_id_already_exists"),
        (fresh, "new_user"),
        (F.col("_found").isNull(), "existing_user_not_found"),
        (~F.col("_active"), "existing_user_inactive"),
        (given & (F.col("_held") != F.col("external_id")), "external_id_mismatch"),
        (taken & (F.col("_holder") != F.col("existing_user_id")), "external_id_already_exists"),
        (given & F.col("_held").isNull(), "filled"),
        default="matched",
    )
    return rows.withColumn("match_status", status).drop("_active", "_held", "_found", "_holder")


def approval_view(requests: DataFrame, institutions: DataFrame, now: Column) -> DataFrame:
    """What an approval link shows: first of expired, not pending, institution_inactive, else success."""
    live = institutions.where("active").select("institution_id", F.col("label").alias("institution_label"))
    rows = requests.join(live, "institution_id", "left")
    status = first_match(
        ((F.col("status") == "pending") & (F.col("expires_at") <= now), "expired"),
        (F.col("status") != "pending", "request_not_pending"),
        (F.col("institution_label").isNull(), "institution_inactive"),
        default="success",
    )
    return rows.withColumn("status_code", status)


def presented_links(presented: DataFrame, links: DataFrame, requests: DataFrame, institutions: DataFrame, now: Column) -> DataFrame:
    """What every presented link (presented_id, link_hash) shows: invalid_link where it leads to no request, else as :func:`approval_view`.

    ``links``: link_hash, request_id. A link that is null or unknown, or whose request is gone, is invalid.
    """
    held = links.join(requests, "request_id")
    known = presented.join(held, "link_hash", "left")
    viewed = approval_view(known.where("request_id is not null"), institutions, now)
    lost = known.where("request_id is null").withColumn("status_code", F.lit("invalid_link"))
    return viewed.unionByName(lost, allowMissingColumns=True)


def approval_choices(requests: DataFrame, channels: DataFrame, users: DataFrame) -> DataFrame:
    """Channels (``all`` first) and active users offered per request's institution, one row each.

    Lists stay rows keyed by institution with a sort key: an institution may
    hold any share of all users.
    """
    tenants = requests.select("institution_id").distinct()
    offered = channels.where("enabled").select(
        "institution_id", F.lit("channel").alias("kind"), F.col("channel_id").alias("item_id"), F.col("label"),
        F.when(F.col("channel_id") == "all", 0).otherwise(1).alias("rank"),
    )
    people = users.where("active").select(
        "institution_id", F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("item_id"),
        F.col("display_name").alias("label"), F.lit(0).alias("rank"),
    )
    rows = offered.unionByName(people).join(tenants, "institution_id", "left_semi")
    return rows.withColumn("sort_key", F.concat_ws("|", F.col("rank").cast("string"), F.lower("label"), "item_id")).drop("rank")
