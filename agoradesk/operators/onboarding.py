"""Published onboarding content: filters, scope, sections and bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match
from agoradesk.operators.ordered import place_key

SCOPE = ("service_id", "job_id", "unit_id")
# Content shown as practical information.
INFO_TYPES = ("meal", "key_info", "schedule", "location")


def published(df: DataFrame, audience: str | None = None) -> DataFrame:
    """Published, active rows meant for everyone or for ``audience`` (all audiences when not given)."""
    live = df.where((F.col("status") == "published") & F.col("active"))
    if audience is None:
        return live
    return live.where(F.col("audience").isNull() | (F.col("audience") == audience))


def published_scope(*tables: DataFrame) -> DataFrame:
    """Distinct (service, job, unit) triples any published table refers to.

    Each table is reduced before the union, so the second distinct sees triples only.
    """
    parts = [t.select(*SCOPE).distinct() for t in tables]
    return reduce(DataFrame.unionByName, parts).distinct()


def referenced_dims(dims: DataFrame, scope: DataFrame, key: str, parents: DataFrame | None = None) -> DataFrame:
    """Active services, jobs or units that published content refers to, below active parents."""
    used = scope.where(F.col(key).isNotNull()).select(key)
    out = dims.where("active").join(used, key, "left_semi")
    if parents is not None:
        out = out.join(parents.where("active").select("service_id"), "service_id", "left_semi")
    return out


def mask_contacts(df: DataFrame) -> DataFrame:
    """Phone and e-mail appear only when each was validated for publication."""
    return df.withColumns(
        {
            "phone": F.when(F.col("phone_validated"), F.col("phone")),
            "email": F.when(F.col("email_validated"), F.col("email")),
        }
    )


def document_availability(df: DataFrame) -> DataFrame:
    """Storage locations are never shown, only whether the document can be had."""
    available = F.col("storage_path").isNotNull() | F.col("external_url").isNotNull()
    return df.withColumn("available", available).drop("storage_path", "external_url")


def in_scope(item: dict[str, Column], profile: dict[str, Column]) -> Column:
    """An item without a service, job or unit fits every profile; otherwise they must agree."""
    fits = [item[k].isNull() | item[k].eqNullSafe(profile[k]) for k in SCOPE]
    return fits[0] & fits[1] & fits[2]


def items_for_scopes(items: DataFrame, scopes: DataFrame, tenant: str) -> DataFrame:
    """Visible items of each distinct (tenant, service, job, unit) of ``scopes``.

    An item stands under the one pattern of columns that it fixes, a scope looks under each pattern that it can fill, at most eight: one
    equi-join in which no pair is formed that is not a result. Columns of ``items`` named like the scope's are left out.
    """
    fixed = [F.col(k).isNotNull() for k in SCOPE]
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fixed)), F.lit(0))
    held = items.withColumn("_key", F.struct(tenant, mask.alias("mask"), *SCOPE)).drop(tenant, *SCOPE)
    asked = scopes.select(tenant, *SCOPE).distinct()
    pattern = lambda m: F.when(
        reduce(lambda x, y: x & y, [f for i, f in enumerate(fixed) if m >> i & 1], F.lit(True)),
        F.struct(F.col(tenant), F.lit(m).alias("mask"), *[F.when(F.lit(bool(m >> i & 1)), F.col(k)).alias(k) for i, k in enumerate(SCOPE)]))
    looks = asked.withColumn("_key", F.explode(F.array_compact(F.array(*[pattern(m) for m in range(8)]))))
    return looks.join(held, "_key").drop("_key")


def items_for_profiles(items: DataFrame, profiles: DataFrame, tenant: str) -> DataFrame:
    """Visible items per profile: those of its scope, which are found once for all profiles that share it."""
    key = [tenant, *SCOPE]
    seen = items_for_scopes(items, profiles, tenant)
    seen = seen.withColumn("_scope", place_key(key)).drop(*key)
    return profiles.withColumn("_scope", place_key(key)).join(seen, "_scope").drop("_scope")


def profile_state(profiles: DataFrame, services: DataFrame, jobs: DataFrame, units: DataFrame) -> DataFrame:
    """Readiness of a profile: service chosen, and job / unit where the service has any."""
    has_jobs = jobs.groupBy("service_id").agg(F.count("*").alias("_jobs"))
    has_units = units.groupBy("service_id").agg(F.count("*").alias("_units"))
    known = services.select("service_id", F.lit(True).alias("_service"))
    rows = profiles.join(known, "service_id", "left").join(has_jobs, "service_id", "left").join(has_units, "service_id", "left")
    state = first_match(
        (F.col("_service").isNull(), "service_required"),
        ((F.coalesce("_jobs", F.lit(0)) > 0) & F.col("job_id").isNull(), "job_required"),
        ((F.coalesce("_units", F.lit(0)) > 0) & F.col("unit_id").isNull(), "unit_required"),
        default="ready",
    )
    return rows.withColumn("profile_state", state).drop("_service", "_jobs", "_units")


def content_section(block_type: Column) -> Column:
    return F.when(block_type == "welcome", "welcome").when(block_type.isin(*INFO_TYPES), "info").otherwise("content")


def faq_search(faq: DataFrame, queries: DataFrame | str) -> DataFrame:
    """FAQ rows whose question, answer or category contains the query, ignoring case.

    A text is one query for every tenant. A table (institution_id, query_id, query) is searched within each tenant's own rows; the
    result has one row per hit with its query_id. A blank or null query finds every row of the tenant.
    """
    haystack = F.lower(F.concat_ws(" ", "question", "answer", F.coalesce("category", F.lit(""))))
    if isinstance(queries, str):
        needle = F.lower(F.trim(F.lit(queries)))
        return faq.where((needle == "") | F.contains(haystack, needle))
    asked = queries.select(
        F.col("institution_id").alias("_tenant"), "query_id", F.lower(F.trim(F.coalesce("query", F.lit("")))).alias("_needle")
    )
    held = faq.withColumn("_text", haystack)
    hit = (F.col("institution_id") == F.col("_tenant")) & ((F.col("_needle") == "") | F.contains("_text", "_needle"))
    return held.join(asked, hit).drop("_tenant", "_needle", "_text")


def bundle_rows(sections: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The bundle as rows (tenant, audience, section, sort key, item JSON).

    A tenant may own any share of the content, so a bundle is not gathered into
    one value; written partitioned by tenant and audience it is read back whole.
    """
    parts = []
    for name, df in sections.items():
        item = F.to_json(F.struct(*[c for c in df.columns if c not in {*keys, "sort_key"}]))
        parts.append(df.select(*keys, F.lit(name).alias("section"), "sort_key", item.alias("item")))
    return reduce(DataFrame.unionByName, parts)
