"""Data-quality reports: constraints, uniqueness, references, typed values, registries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match
from agoradesk.operators.events import illegal_transitions
from agoradesk.operators.ordered import with_neighbours


def filter_optional(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality, membership or flag predicates, each applied only when a value is given."""
    for name, value in wanted.items():
        if value is None:
            continue
        df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == F.lit(value))
    return df


def quality_report(df: DataFrame, key: list[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per violated rule; a rule that is null is not violated, as in a table check."""
    checks = F.array(*[F.when(~cond, F.lit(name)) for name, cond in rules.items()])
    return df.select(*key, F.explode(F.array_compact(checks)).alias("rule"))


def duplicate_report(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Key values held by more than one row, among the rows the partial rule covers."""
    rows = df if where is None else df.where(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def orphan_report(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose whole composite key is missing from the parent; null keys refer to nothing."""
    given = child
    for k in keys:
        given = given.where(F.col(k).isNotNull())
    return given.join(parent.select(*keys), keys, "left_anti")


def typed_value_report(conditions: DataFrame, facts: DataFrame, values: DataFrame) -> DataFrame:
    """Condition values against the template: bounds, whole numbers, closed categories.

    conditions: template_id, rule_id, fact_key, number_value, category_value.
    """
    spec = facts.select("template_id", "fact_key", "value_type", "minimum_number", "maximum_number", "integer_only")
    known = values.select("template_id", "fact_key", F.col("value_key").alias("category_value"), F.lit(True).alias("_known"))
    rows = conditions.join(spec, ["template_id", "fact_key"], "left").join(known, ["template_id", "fact_key", "category_value"], "left")
    n = F.col("number_value")
    code = first_match(
        (F.col("value_type").isNull(), "unknown_fact"),
        ((F.col("value_type") == "number") & n.isNull(), "number_expected"),
        ((F.col("value_type") == "category") & F.col("category_value").isNull(), "category_expected"),
        (n < F.col("minimum_number"), "below_minimum"),
        (n > F.col("maximum_number"), "above_maximum"),
        (F.col("integer_only") & (n != F.floor(n)), "integer_expected"),
        ((F.col("value_type") == "category") & F.col("_known").isNull(), "category_not_in_list"),
    )
    return rows.withColumn("code", code).where("code is not null").drop("_known")


def registry_report(used: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys used but not registered, registered keys in use) over (owner, key_type, runtime_key)."""
    keys = ["key_type", "runtime_key"]
    missing = used.join(registry.select(*keys), keys, "left_anti")
    in_use = registry.join(used.select(*keys).distinct(), keys, "left_semi")
    return missing, in_use


TEMPLATE_STEPS = (("draft", "draft"), ("draft", "published"), ("published", "published"), ("published", "retired"))


def template_change_report(history: DataFrame, keys: list[str], order: list[str], bucket: Column, business: list[str]) -> DataFrame:
    """Changes a template version may not make: out of retirement, or of content once published."""
    moved = with_neighbours(
        history, keys, order, bucket,
        lag={"from_status": F.col("status"), "_was": F.xxhash64(*business)},
    ).withColumn("_is", F.xxhash64(*business))
    changed = F.col("_was") != F.col("_is")
    code = first_match(
        (F.col("from_status") == "retired", "retired_version_immutable"),
        ((F.col("from_status") == "published") & ~F.col("status").isin("published", "retired"), "published_version_only_retires"),
        ((F.col("from_status") == "published") & changed, "published_version_immutable"),
    )
    return moved.withColumn("code", code).where("code is not null").drop("_was", "_is")


__all__ = [
    "filter_optional", "quality_report", "duplicate_report", "orphan_report", "typed_value_report", "registry_report",
    "template_change_report", "illegal_transitions",
]
