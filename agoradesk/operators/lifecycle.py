"""Document life: upload admission, ingestion, activation, removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match
from agoradesk.operators.ordered import latest_per_key

# Lease, open rule states.
LEASE_MINUTES = 15
OPEN_RULES = ("proposed", "needs_attention", "approved", "validated")


def _flag(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return df.select(*keys).distinct().withColumn(name, F.lit(True))


def _yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def classify_ingestion(docs: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """May a document's ingestion start? Looks at its status and its latest job."""
    last = latest_per_key(jobs, ["document_id", "institution_id"], ["created_at", "job_id"]).select(
        "document_id", "institution_id", "job_id", F.col("status").alias("job_status"), "attempt_count", "max_attempts", "locked_at"
    )
    rows = docs.join(last, ["document_id", "institution_id"], "left")
    leased = F.col("locked_at") >= now - F.make_dt_interval(mins=F.lit(LEASE_MINUTES))
    status = first_match(
        (F.col("status").isin("ready", "active"), "already_ready"),
        (F.col("status") == "obsolete", "document_obsolete"),
        (F.col("job_id").isNull(), "job_not_found"),
        (F.col("job_status") == "succeeded", "already_ready"),
        (F.col("job_status") == "cancelled", "job_cancelled"),
        ((F.col("job_status") == "running") & F.coalesce(leased, F.lit(False)), "already_processing"),
        (F.col("attempt_count") >= F.col("max_attempts"), "retry_exhausted"),
        default="started",
    )
    return rows.withColumn("status_code", status)


def classify_activation(docs: DataFrame, jobs: DataFrame, passages: DataFrame, files: DataFrame) -> DataFrame:
    """May a document become the active version? Passages are counted once, not per document."""
    keys = ["document_id", "institution_id"]
    busy = _flag(jobs.where(F.col("status").isin("queued", "running")), keys, "_busy")
    counts = passages.groupBy(*keys).agg(F.count("*").alias("_n"), F.count_if(F.col("embedding").isNull()).alias("missing_embeddings"))
    stored = _flag(files, ["storage_path"], "_file")
    rows = docs.join(busy, keys, "left").join(counts, keys, "left").join(stored, "storage_path", "left")
    extracted = F.coalesce(F.trim("extraction_method"), F.lit("")) != ""
    status = first_match(
        (F.col("status") == "active", "already_active"),
        (~F.col("status").isin("ready", "inactive"), "document_not_ready"),
        (~extracted, "extraction_incomplete"),
        (_yes("_busy"), "ingestion_in_progress"),
        (F.col("_n").isNull(), "no_passages"),
        (F.col("missing_embeddings") > 0, "embeddings_incomplete"),
        (~_yes("_file"), "source_file_missing"),
        default="activated",
    )
    return rows.withColumn("status_code", status).drop("_busy", "_n", "_file")


def classify_deactivation(docs: DataFrame) -> DataFrame:
    status = first_match(
        (F.col("status") == "inactive", "already_inactive"), (F.col("status") != "active", "document_not_active"), default="deactivated"
    )
    return docs.withColumn("status_code", status)


def classify_removal(requests: DataFrame, docs: DataFrame, jobs: DataFrame, rule_sets: DataFrame) -> DataFrame:
    """May a document be deleted? ``requests``: document_id, institution_id, confirmed, confirmation_title."""
    keys = ["document_id", "institution_id"]
    busy = _flag(jobs.where(F.col("status").isin("queued", "running")), keys, "_busy")
    ruled = _flag(rule_sets.where(F.col("status").isin(*OPEN_RULES)), keys, "_ruled")
    known = docs.select(*keys, F.col("status").alias("_status"), F.col("title").alias("_title"))
    rows = requests.join(known, keys, "left").join(busy, keys, "left").join(ruled, keys, "left")
    status = first_match(
        (~F.coalesce("confirmed", F.lit(False)), "confirmation_required"),
        (F.col("_status").isNull(), "document_not_found"),
        ((F.col("_status") == "processing") | _yes("_busy"), "ingestion_in_progress"),
        (_yes("_ruled"), "document_has_protected_rules"),
        ((F.col("_status") == "active") & (F.coalesce(F.trim("confirmation_title"), F.lit("")) != F.col("_title")), "active_confirmation_required"),
        default="deleted",
    )
    return rows.withColumn("status_code", status).drop("_status", "_title", "_busy", "_ruled")


def classify_uploads(uploads: DataFrame, docs: DataFrame, files: DataFrame, order: list[str]) -> DataFrame:
    """Admission of uploads against stored files, known documents and earlier uploads of the batch.

    uploads: document_id, institution_id, storage_path, size_bytes, mime_type, file_sha256, document_key, version_label.
    """
    parts = F.split("storage_path", "/")
    shaped = (
        (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == F.col("institution_id"))
        & (F.get(parts, F.lit(1)) == F.col("document_id").cast("string")) & (F.trim(F.get(parts, F.lit(2))) != "")
    )
    stored = files.select("storage_path", F.col("size_bytes").alias("_size"), F.col("mime_type").alias("_mime"), F.lit(True).alias("_file"))
    known = _flag(docs, ["institution_id", "file_sha256"], "_same_file")
    versions = _flag(docs, ["institution_id", "document_key", "version_label"], "_same_version")
    rows = (
        uploads.withColumn("_shaped", F.coalesce(shaped, F.lit(False))).join(stored, "storage_path", "left")
        .join(known, ["institution_id", "file_sha256"], "left").join(versions, ["institution_id", "document_key", "version_label"], "left")
    )
    early = first_match(
        (~F.col("_shaped"), "invalid_storage_path"),
        (~_yes("_file"), "source_file_missing"),
        ((F.col("_size") != F.col("size_bytes")) | (F.col("_mime") != F.col("mime_type")), "source_metadata_mismatch"),
        (_yes("_same_file"), "duplicate_file"),
        (_yes("_same_version"), "version_already_exists"),
    )
    rows = rows.withColumn("_early", early)
    # Within the batch the first admissible upload of a file, then of a version, wins.
    ok = rows.where("_early is null")
    place = F.struct(*order)
    first_file = ok.groupBy("institution_id", "file_sha256").agg(F.min(place).alias("_first_file"))
    rows = rows.join(first_file, ["institution_id", "file_sha256"], "left")
    leads = rows.where(F.col("_early").isNull() & (place == F.col("_first_file")))
    first_version = leads.groupBy("institution_id", "document_key", "version_label").agg(F.min(place).alias("_first_version"))
    rows = rows.join(first_version, ["institution_id", "document_key", "version_label"], "left")
    late = first_match(
        (place != F.col("_first_file"), "duplicate_file"), (place != F.col("_first_version"), "version_already_exists"), default="registered"
    )
    return rows.withColumn("status_code", F.coalesce("_early", late)).drop(
        "_shaped", "_size", "_mime", "_file", "_same_file", "_same_version", "_early", "_first_file", "_first_version"
    )
