"""Rule sets and templates as nested rows, assembled bottom-up: one aggregation per level, never a query per row.

Groups are bounded by the model (rules of a set, conditions of a group, facts of a template). Lists are ordered; nulls come last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.operators.reporting import collect_sorted

CONDITION = ["fact_key", "fact_value_type", "comparator", "number_value", "category_value"]
FACT = ["fact_key", "value_type", "extractor_key", "minimum_number", "maximum_number", "integer_only", "allowed_operators", "category_values"]
CONSTRAINT = ["constraint_key", "left_fact_key", "comparator", "right_fact_key", "error_code"]
VERSION = ["template_version_id", "version_number", "status", "published_at", "retired_at"]


def _lists(df: DataFrame, keys: list[str], order: list[str], values: list[str], name: str) -> DataFrame:
    """``collect_sorted`` with nulls last in every column of ``order``."""
    flags = {f"_null_{c}": F.col(c).isNull() for c in order}
    return collect_sorted(df.withColumns(flags), keys, [x for c in order for x in (f"_null_{c}", c)], values, name)


def _short_lists(df: DataFrame, key: str, order: list[str], item: Column, name: str) -> DataFrame:
    """Lists as by ``_lists`` for many keys with a few rows each (the model bounds them): rows are sorted once by key and order.

    A grouping into lists would sort them by key before and after they travel, and once more for the join that follows. Rows without a key
    belong to no parent and are left out.
    """
    whole = Window.partitionBy(key).orderBy(*[F.col(c).asc_nulls_last() for c in order], "_item")
    rows = df.where(F.col(key).isNotNull()).withColumn("_item", item)
    listed = F.collect_list("_item").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(key, F.row_number().over(whole).alias("_place"), listed.alias(name)).where("_place = 1").drop("_place")


def _attach(parents: DataFrame, children: DataFrame, keys: list[str], name: str, empty: bool) -> DataFrame:
    """Parents with the list of their children; without any it is empty, or null where ``empty`` is false."""
    out = parents.join(children, keys, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(children.schema[name].dataType))) if empty else out


def template_documents(versions: DataFrame, facts: DataFrame, operators: DataFrame, categories: DataFrame, constraints: DataFrame) -> DataFrame:
    """``versions`` with ``facts`` (by display order and key, each with its operators and category values) and ``fact_constraints``."""
    key, fact = ["template_version_id"], ["template_version_id", "fact_key"]
    allowed = operators.groupBy(*fact).agg(F.array_sort(F.collect_list("comparator")).alias("allowed_operators"))
    values = _lists(categories, fact, ["display_order", "value_key"], ["value_key", "label"], "category_values")
    held = _attach(_attach(facts, allowed, fact, "allowed_operators", True), values, fact, "category_values", True)
    out = _attach(versions, _lists(held, key, ["display_order", "fact_key"], FACT, "facts"), key, "facts", True)
    return _attach(out, _lists(constraints, key, ["constraint_key"], CONSTRAINT, "fact_constraints"), key, "fact_constraints", True)


def rule_set_documents(sets: DataFrame, rules: DataFrame, groups: DataFrame, conditions: DataFrame, sources: DataFrame, templates: DataFrame) -> DataFrame:
    """One row per rule set with ``rules`` and ``template`` (a row of :func:`template_documents`, null where its version is unknown).

    Rules are ordered by display order and id; each has its condition groups with their conditions, and the ids of its passages. A rule
    without groups has an empty list; lists of conditions, passages and rules are null where there are none.
    """
    parts = _short_lists(conditions, "condition_group_id", CONDITION[:1] + CONDITION[2:], F.struct(*CONDITION), "conditions")
    whole = _attach(groups, parts, ["condition_group_id"], "conditions", False)
    grouped = _short_lists(whole, "rule_id", ["display_order", "condition_group_id"], F.struct("condition_group_id", "conditions"), "condition_groups")
    cited = _short_lists(sources, "rule_id", [], F.col("passage_id"), "source_passage_ids")
    full = _attach(_attach(rules, grouped, ["rule_id"], "condition_groups", True), cited, ["rule_id"], "source_passage_ids", False)
    item = ["rule_id", "outcome_value", "is_default", "label", "condition_groups", "source_passage_ids"]
    out = _attach(sets, _lists(full.repartition("rule_set_id"), ["rule_set_id"], ["display_order", "rule_id"], item, "rules"), ["rule_set_id"], "rules", False)
    named = templates.select("template_version_id", F.struct(*templates.columns).alias("template"))
    return out.join(named, "template_version_id", "left")


def template_catalog(templates: DataFrame, versions: DataFrame) -> DataFrame:
    """Templates with their versions in the order of their numbers; a template without versions has an empty list."""
    listed = _lists(versions, ["template_key"], ["version_number"], VERSION, "versions")
    return _attach(templates, listed, ["template_key"], "versions", True)
