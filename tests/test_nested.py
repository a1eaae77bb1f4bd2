"""Nested rule sets: order at every level, empty and missing lists."""

from pyspark.sql import functions as F

from agoradesk.operators import nested


def test_rule_sets_are_nested_in_order(spark):
    make = spark.createDataFrame
    versions = make([("v", "days"), ("w", "days")], "template_version_id string, result_unit string")
    fact = "template_version_id string, fact_key string, display_order int, value_type string, extractor_key string, minimum_number long, maximum_number long, integer_only boolean"
    facts = make([("v", "b", 1, "number", "x", 0, 9, True), ("v", "a", 1, "category", "y", None, None, None), ("v", "c", 0, "number", "z", 1, 2, False)], fact)
    operators = make([("v", "b", "<"), ("v", "b", "="), ("v", "a", "=")], "template_version_id string, fact_key string, comparator string")
    categories = make([("v", "a", None, "last", "L"), ("v", "a", 1, "first", "F")], "template_version_id string, fact_key string, display_order int, value_key string, label string")
    constraints = make([], "template_version_id string, constraint_key string, left_fact_key string, comparator string, right_fact_key string, error_code string")
    templates = nested.template_documents(versions, facts, operators, categories, constraints)

    sets = make([(1, "v"), (2, "unknown")], "rule_set_id long, template_version_id string")
    rules = make([("r2", 1, 5, 2, False, "two"), ("r1", 1, 3, 2, False, "one"), ("r0", 1, 1, 9, True, "none")],
                 "rule_id string, rule_set_id long, outcome_value long, display_order int, is_default boolean, label string")
    groups = make([("r1", "g2", 1), ("r1", "g1", 2), ("r2", "g3", 0)], "rule_id string, condition_group_id string, display_order int")
    conditions = make([("g1", "a", "number", ">=", None, "z"), ("g1", "a", "number", ">=", 4, None), ("g2", "b", "number", "<", 1, None)],
                      "condition_group_id string, fact_key string, fact_value_type string, comparator string, number_value long, category_value string")
    sources = make([("r1", 9), ("r1", 3)], "rule_id string, passage_id long")
    one, two = nested.rule_set_documents(sets, rules, groups, conditions, sources, templates).orderBy("rule_set_id").collect()
    assert [r["rule_id"] for r in one["rules"]] == ["r1", "r2", "r0"]
    first, second, third = one["rules"]
    assert [g["condition_group_id"] for g in first["condition_groups"]] == ["g2", "g1"] and first["source_passage_ids"] == [3, 9]
    assert [c["number_value"] for c in first["condition_groups"][1]["conditions"]] == [4, None]
    assert second["condition_groups"][0]["conditions"] is None and second["source_passage_ids"] is None and third["condition_groups"] == []
    assert [f["fact_key"] for f in one["template"]["facts"]] == ["c", "a", "b"] and one["template"]["fact_constraints"] == []
    assert [v["value_key"] for v in one["template"]["facts"][1]["category_values"]] == ["first", "last"]
    assert one["template"]["facts"][2]["allowed_operators"] == ["<", "="] and one["template"]["facts"][0]["allowed_operators"] == []
    assert two["rules"] is None and two["template"] is None


def test_short_lists_are_sorted_once_and_keep_copies_and_nulls(spark):
    make = spark.createDataFrame
    rows = make([("k", 2, "b"), ("k", None, "c"), ("k", 1, "a"), ("k", 1, "a"), (None, 1, "x"), ("m", None, None)], "k string, o int, v string")
    out = nested._short_lists(rows, "k", ["o"], F.struct("v"), "held")
    assert {r.k: [x.v for x in r.held] for r in out.collect()} == {"k": ["a", "a", "b", "c"], "m": [None]}
    assert nested._short_lists(make([("k", None)], "k string, v long"), "k", [], F.col("v"), "held").first().held == []

    condition = make([("g", "a", "number", ">=", 1, None)], "condition_group_id string, fact_key string, fact_value_type string, comparator string, number_value long, category_value string")
    sets, templates = make([(1, "v")], "rule_set_id long, template_version_id string"), make([("v",)], "template_version_id string")
    rules = make([("r", 1, 5, 2, False, "x")], "rule_id string, rule_set_id long, outcome_value long, display_order int, is_default boolean, label string")
    groups = make([("r", "g", 1), ("r", "g", 1)], "rule_id string, condition_group_id string, display_order int")
    out = nested.rule_set_documents(sets, rules, groups, condition, make([("r", 3)], "rule_id string, passage_id long"), templates)
    (rule,) = out.first()["rules"]
    assert [[c["number_value"] for c in g["conditions"]] for g in rule["condition_groups"]] == [[1], [1]] and rule["source_passage_ids"] == [3]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate(keys=[rule_set_id" in plan and not any(f"ObjectHashAggregate(keys=[{k}" in plan for k in ("rule_id", "condition_group_id"))


def test_catalogue_orders_versions(spark):
    templates = spark.createDataFrame([("t", "T"), ("u", "U")], "template_key string, name string")
    versions = spark.createDataFrame(
        [("t", "t2", 2, "published", "b", None), ("t", "t1", 1, "retired", "a", "b")],
        "template_key string, template_version_id string, version_number int, status string, published_at string, retired_at string")
    out = {r["template_key"]: [v["version_number"] for v in r["versions"]] for r in nested.template_catalog(templates, versions).collect()}
    assert out == {"t": [1, 2], "u": []}
