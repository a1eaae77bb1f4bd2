"""Dashboards, lists, pages and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.functions.columns import clamp, safe_token
from agoradesk.operators.ordered import latest_per_key, with_running

# Log bounds, batch size.
MAX_DURATION_MS = 300_000
BATCH_SIZE = 16


def user_dashboard(users: DataFrame, memberships: DataFrame, channels: DataFrame, devices: DataFrame) -> DataFrame:
    """Per user: sorted channel labels, devices in use, latest sign of life of any device.

    Devices are aggregated before the join, so nothing fans out.
    """
    labels = (
        memberships.join(channels.select("institution_id", "channel_id", "label"), ["institution_id", "channel_id"])
        .groupBy("user_id", "institution_id")
        .agg(F.array_sort(F.collect_set("label")).alias("channels"))
    )
    seen = devices.where("user_id is not null").groupBy("user_id").agg(
        F.count_distinct(F.when(F.col("revoked_at").isNull(), F.col("device_id"))).alias("device_count"),
        F.max("last_seen_at").alias("last_seen_at"),
    )
    out = users.join(labels, ["user_id", "institution_id"], "left").join(seen, "user_id", "left")
    return out.withColumns(
        {
            "channels": F.coalesce("channels", F.array().cast("array<string>")),
            "device_count": F.coalesce("device_count", F.lit(0)),
        }
    )


def collect_sorted(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str) -> DataFrame:
    """Ordered array of structs per key, for groups the model bounds (rules of a set, facts of a template)."""
    packed = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*values).alias("item"))
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(packed)), lambda s: s["item"]).alias(name)
    )


def list_documents(docs: DataFrame, jobs: DataFrame, tenant: str = "institution_id", limit: int | None = None) -> DataFrame:
    """Documents per tenant with their place in the list, newest first, and their latest job; all of them unless ``limit`` is set.

    Places are counted within days and the days of a tenant are added up, so a tenant of very many documents is many tasks.
    A document without a time comes last.
    """
    day = F.coalesce(-F.unix_date(F.col("created_at").cast("date")), F.lit(2**31 - 1))
    placed = with_running(docs, [tenant], [F.desc("created_at"), F.desc("document_id")], day, {"position": F.lit(1)})
    listed = placed if limit is None else placed.where(F.col("position") <= limit)
    job = latest_per_key(jobs, ["document_id"], ["job_created_at", "job_id"])
    return listed.join(job.drop(tenant), "document_id", "left")


def keyset_page(df: DataFrame, order: list[str], n: int, cursor: tuple | None = None) -> DataFrame:
    """One page in descending ``order``, with ``has_more`` and the encoded ``next_cursor``.

    One row more than the page is fetched, which tells whether another follows. Only these n + 1 rows reach the windows.
    """
    rows = df
    if cursor is not None:
        at = F.struct(*[F.lit(v).cast(dict(df.dtypes)[c]).alias(c) for c, v in zip(order, cursor)])
        rows = df.where(F.struct(*order) < at)
    down = [F.desc(c) for c in order]
    fetched = rows.orderBy(*down).limit(n + 1)
    whole = Window.orderBy(*down).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in order])
    counted = fetched.withColumns({"_at": F.row_number().over(Window.orderBy(*down)), "has_more": F.count(F.lit(1)).over(whole) > n})
    last = F.max(F.when(F.col("_at") == n, key)).over(whole)
    return counted.withColumn("next_cursor", F.when(F.col("has_more"), F.base64(last.cast("binary")))).where(F.col("_at") <= n).drop("_at")


def decode_cursor(col: Column) -> Column:
    """(timestamp text, id text) of a cursor; null when it is not one."""
    parts = F.split(F.unbase64(col).cast("string"), "\\|")
    return F.when(F.size(parts) == 2, F.struct(parts[0].alias("at"), parts[1].alias("id")))


def token_usage(log: DataFrame, keys: list[str]) -> DataFrame:
    prompt, completion = safe_token(F.col("prompt_tokens")), safe_token(F.col("completion_tokens"))
    return log.groupBy(*keys).agg(
        F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"),
        F.sum(prompt + completion).alias("total_tokens"),
    )


def duration_ms(col: Column) -> Column:
    return clamp(F.round(col), 0, MAX_DURATION_MS)


def duration_sketches(log: DataFrame, keys: list[str], size: int = 400) -> DataFrame:
    """One quantile sketch of the durations (as logged) per group: a few kilobytes, whatever the number of requests.

    Rows without a duration are counted in ``requests`` only. ``size`` sets the error: a quantile's rank is off by about 1.2 % at 400.
    """
    value = F.col("duration_ms").cast("double")
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("requests"), F.kll_sketch_agg_double(value, size).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser groups from finer ones, without the log."""
    return sketches.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("merged"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketch_percentiles(sketches: DataFrame, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Columns p50, p95, … of each sketch; null where no duration was logged."""
    some = F.kll_sketch_get_n_double("sketch") > 0
    return sketches.withColumns(
        {f"p{p}": F.when(some, F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100))) for p in percents}
    ).drop("sketch")


def request_log_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """Outcome counts, duration (clamped, and as logged), passages and similarity of answered requests."""
    ms = duration_ms(F.col("duration_ms"))
    return log.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(F.col("result") == "supported").alias("supported"),
        F.count_if(F.col("result") == "insufficient_sources").alias("insufficient"),
        F.count_if(F.col("result") == "error").alias("errors"),
        F.count_if(F.col("error_code").isNotNull()).alias("with_error_code"),
        F.sum(ms).alias("duration_ms"),
        F.max(ms).alias("max_duration_ms"),
        F.sum(F.round("duration_ms")).alias("unclamped_duration_ms"),
        F.sum("passages_used").alias("passages_used"),
        F.avg("similarity").alias("mean_similarity"),
    )


def ingestion_progress(jobs: DataFrame, passages: DataFrame, job: str = "job_id") -> DataFrame:
    """Stored passages against the plan, and batches of 16 they fill."""
    done = passages.groupBy(job).agg(
        F.count("*").alias("processed_items"),
        F.count_if(~F.col("embedded")).alias("missing_embeddings"),
        F.max(F.floor(F.col("chunk_index") / BATCH_SIZE)).alias("last_batch"),
    )
    out = jobs.join(done, job, "left").withColumns(
        {"processed_items": F.coalesce("processed_items", F.lit(0)), "missing_embeddings": F.coalesce("missing_embeddings", F.lit(0))}
    )
    complete = (F.col("processed_items") == F.col("total_items")) & (F.col("missing_embeddings") == 0)
    return out.withColumn("status_code", F.when(complete, "complete").otherwise("ingestion_incomplete"))


def corpus_stats(passages: DataFrame, key: str) -> DataFrame:
    return passages.groupBy(key).agg(
        F.count("*").alias("passages"),
        F.sum(F.length("content")).alias("characters"),
        F.sum("token_count").alias("tokens"),
        F.bool_or("metadata.structural_order_normalized").alias("any_reordered"),
    )


def checklist_progress(items: DataFrame, done: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Whole percent of checked items per profile; 0 where a profile has no item."""
    ticked = items.join(done.select(*keys, item).distinct().withColumn("_done", F.lit(1)), [*keys, item], "left")
    share = F.floor(F.avg(F.coalesce("_done", F.lit(0))) * 100 + 0.5)
    return ticked.groupBy(*keys).agg(F.count(item).alias("items"), F.sum(F.coalesce("_done", F.lit(0))).alias("done"),
                                     F.coalesce(share, F.lit(0)).alias("percent"))


def pending_requests(requests: DataFrame, now: Column) -> DataFrame:
    return requests.where((F.col("status") == "pending") & (F.col("expires_at") > now))
