"""Entitlement rules: three-valued conditions, outcomes, what-if outcomes and answers.

A rule set is bounded (100 rules of 20 groups of 20 conditions), so it is one
nested row. Questions are joined to it by tenant and template and judged in
place: they are never multiplied by rules or conditions, and not shuffled at
all while the rule sets are small enough to be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import compare, first_match, labelled, let, number_text
from agoradesk.operators.questions import ANNUAL_LEAVE, EXCEPTIONAL_LEAVE, EXTRACTORS, extract_facts, read_questions, template_traits

# Statuses, strategies, wording.
STRATEGY = "maximum_applicable_entitlement"
REGISTRY = {
    "aggregation_strategy": ("maximum_applicable_entitlement",),
    "fact_extractor": tuple(sorted(EXTRACTORS)),
    "intent_detector": ("annual_leave_intent_v1", "exceptional_leave_intent_v1"),
    "renderer": ("annual_leave_answer_fr_v1", "exceptional_leave_answer_fr_v1"),
}
BLOCKED = "Je ne peux pas déterminer ce droit de manière suffisamment fiable à partir des informations disponibles."
RULE_REQUIRED = "Cette disposition nécessite une vérification avant que je puisse déterminer ton droit individuel."
REASON_LABELS = {
    "marriage": "un mariage ou un partenariat enregistré",
    "death_first_degree": "le décès d'un parent au premier degré",
    "death_second_degree": "le décès d'un parent au deuxième degré",
    "moving": "un déménagement",
}
REQUIREMENT = {">=": "au moins", ">": "plus de", "<=": "au plus", "<": "moins de", "=": "exactement", "!=": "une valeur différente de"}

CONDITION = "struct<fact_key:string,fact_value_type:string,comparator:string,number_value:double,category_value:string>"
RULE = (
    f"struct<rule_id:string,outcome_value:double,is_default:boolean,label:string,groups:array<array<{CONDITION}>>,"
    "sources:array<string>>"
)
FACT_SPEC = (
    "struct<fact_key:string,value_type:string,extractor_key:string,minimum_number:double,maximum_number:double,integer_only:boolean,"
    "operators:array<string>,categories:array<string>>"
)
OUTCOMES = f"array<struct<outcome_value:double,i:int,requirement_groups:array<array<{CONDITION}>>>>"
CONSTRAINT = "struct<constraint_key:string,left_fact_key:string,comparator:string,right_fact_key:string,error_code:string>"
TEMPLATE = (
    "struct<template_version_id:string,template_key:string,aggregation_strategy:string,result_unit:string,result_value_type:string,"
    "result_integer_only:boolean,result_minimum:double,result_maximum:double,detector_key:string,renderer_key:string,clarification:string,"
    f"facts:array<{FACT_SPEC}>,constraints:array<{CONSTRAINT}>>"
)


def _fact_of(template: Column, key: Column) -> Column:
    return F.get(F.filter(template["facts"], lambda f: f["fact_key"] == key), F.lit(0))


def _known(fact: Column) -> Column:
    return fact["number_value"].isNotNull() | fact["category_value"].isNotNull()


#: What a comparator accepts of "smaller", "equal" and "larger", as bits.
_SMALLER, _EQUAL, _LARGER = 1, 2, 4
ACCEPTED = {"=": _EQUAL, "!=": _SMALLER | _LARGER, "<": _SMALLER, "<=": _SMALLER | _EQUAL, ">": _LARGER, ">=": _LARGER | _EQUAL}


def _limits(cond: Column, template: Column) -> Column:
    """The facts that bound a condition's fact from above, for an unknown fact that a known one keeps from the threshold."""
    least = F.coalesce((cond["fact_value_type"] == "number") & cond["comparator"].isin(">", ">="), F.lit(False))
    bounding = F.filter(template["constraints"], lambda c: least & (c["left_fact_key"] == cond["fact_key"]) & c["comparator"].isin("<", "<="))
    return F.transform(bounding, lambda c: F.struct(c["right_fact_key"].alias("fact_key"), ((c["comparator"] == "<") | (cond["comparator"] == ">")).alias("equal")))


def judged_form(rules: Column, template: Column) -> Column:
    """Rules with all that their conditions take from the set alone, so that it is worked out once per set."""

    def condition(c: Column) -> Column:
        agree = F.coalesce(_fact_of(template, c["fact_key"])["value_type"] == c["fact_value_type"], F.lit(False))
        accepted = F.when(c["number_value"].isNotNull(), labelled(c["comparator"], ACCEPTED))
        named = F.when(c["comparator"].isin("=", "!="), c["category_value"])
        return F.struct(
            c.alias("condition"), agree.alias("agree"), F.coalesce(c["fact_value_type"] == "number", F.lit(False)).alias("number"),
            F.coalesce(accepted, F.lit(0)).alias("accepted"), named.alias("named"), F.coalesce(c["comparator"] == "!=", F.lit(False)).alias("other"),
            F.coalesce(_limits(c, template), F.array().cast("array<struct<fact_key:string,equal:boolean>>")).alias("limits"),
        )

    return F.transform(rules, lambda r, i: F.struct(
        r["outcome_value"].alias("outcome_value"), r["is_default"].alias("is_default"), r["sources"].alias("sources"), i.alias("i"),
        F.transform(r["groups"], lambda g: F.transform(g, condition)).alias("groups"),
    ))


def eval_condition(cond: Column, facts: Column) -> Column:
    """true, false or null (unknown), of a condition in its judged form."""
    said = cond["condition"]

    def beyond(limit: Column) -> Column:
        n, most = said["number_value"], facts[limit["fact_key"]]["number_value"]
        return F.coalesce((n > most) | (limit["equal"] & (n >= most)), F.lit(False))

    def judge(fact: Column) -> Column:
        number, threshold = fact["number_value"], said["number_value"]
        side = F.when(number < threshold, _SMALLER).when(number == threshold, _EQUAL).otherwise(_LARGER)
        by_number = number.isNotNull() & (side.bitwiseAND(cond["accepted"]) != 0)
        by_category = F.coalesce((fact["category_value"] == cond["named"]) != cond["other"], F.lit(False))
        return (
            F.when(~cond["agree"], F.lit(False))
            .when(~F.coalesce(_known(fact), F.lit(False)), F.when(F.exists(cond["limits"], beyond), F.lit(False)))
            .when(cond["number"], by_number)
            .otherwise(by_category)
        )

    return let(facts[said["fact_key"]], judge)


def eval_group(group: Column, facts: Column) -> Column:
    """AND in three-valued logic: false wins over unknown."""
    return F.forall(group, lambda c: eval_condition(c, facts))


def eval_rule(rule: Column, facts: Column) -> Column:
    """OR in three-valued logic: true wins over unknown; a default rule is true."""
    return F.when(rule["is_default"], F.lit(True)).otherwise(
        F.exists(rule["groups"], lambda g: eval_group(g, facts))
    )


def _acceptable(spec: Column, number: Column, category: Column) -> Column:
    whole = ~spec["integer_only"] | (number == F.floor(number))
    low = spec["minimum_number"].isNull() | (number >= spec["minimum_number"])
    high = spec["maximum_number"].isNull() | (number <= spec["maximum_number"])
    return F.when(spec["value_type"] == "number", whole & low & high & ~F.isnan(number)).otherwise(
        F.array_contains(spec["categories"], category)
    )


def _sound_condition(c: Column, template: Column) -> Column:
    def judge(spec: Column) -> Column:
        typed = F.when(c["fact_value_type"] == "number", c["number_value"].isNotNull() & c["category_value"].isNull()).otherwise(
            c["number_value"].isNull() & c["category_value"].isNotNull()
        )
        usable = (spec["value_type"] == c["fact_value_type"]) & F.array_contains(spec["operators"], c["comparator"])
        return F.coalesce(usable & typed & _acceptable(spec, c["number_value"], c["category_value"]), F.lit(False))

    return let(_fact_of(template, c["fact_key"]), judge)


def rule_set_problem() -> Column:
    """First structural problem of a nested rule set row, or null."""
    t, rules = F.col("template"), F.col("rules")
    keys = F.transform(t["facts"], lambda f: f["fact_key"])
    stray = F.exists(
        t["constraints"],
        lambda c: ~F.array_contains(keys, c["left_fact_key"]) | ~F.array_contains(keys, c["right_fact_key"]),
    )

    def bad_value(r: Column) -> Column:
        v = r["outcome_value"]
        fine = (
            v.isNotNull() & ~F.isnan(v) & (~t["result_integer_only"] | (v == F.floor(v)))
            & (t["result_minimum"].isNull() | (v >= t["result_minimum"])) & (t["result_maximum"].isNull() | (v <= t["result_maximum"]))
        )
        return ~F.coalesce(fine, F.lit(False)) | (F.size(r["sources"]) == 0)

    def bad_group(g: Column) -> Column:
        return (F.size(g) == 0) | ~F.forall(g, lambda c: _sound_condition(c, t))

    # Rules are checked one after the other, so the first faulty rule names the code.
    per_rule = F.transform(
        rules,
        lambda r: F.when(bad_value(r), "invalid_rule")
        .when(r["is_default"] & (F.size(r["groups"]) > 0), "default_rule_has_conditions")
        .when(~r["is_default"] & (F.size(r["groups"]) == 0), "conditional_rule_without_group")
        .when(F.exists(r["groups"], bad_group), "invalid_condition_group"),
    )
    bound = (
        (t["template_key"] == F.col("rule_key")) & (t["template_version_id"] == F.col("template_version_id"))
        & (t["aggregation_strategy"] == F.col("aggregation_strategy")) & (t["result_unit"] == F.col("result_unit"))
        & (t["result_value_type"] == "number") & (F.size(rules) > 0)
    )
    return F.coalesce(
        first_match(
            ((F.col("status") != "validated") | (F.col("document_status") != "active"), "rule_set_not_active"),
            (~F.coalesce(bound, F.lit(False)), "invalid_template_binding"),
            (F.size(F.array_distinct(keys)) != F.size(keys), "duplicate_template_fact"),
            (F.coalesce(stray, F.lit(False)), "invalid_fact_constraint"),
            (F.size(F.filter(rules, lambda r: r["is_default"])) != 1, "invalid_default_rule_count"),
        ),
        F.get(F.array_compact(per_rule), F.lit(0)),
    )


def validate_rule_sets(sets: DataFrame) -> DataFrame:
    return sets.withColumn("problem", rule_set_problem())


def prepare_rule_sets(sets: DataFrame) -> DataFrame:
    """Validated sets with their rules in judged form, before questions meet them."""
    return validate_rule_sets(sets).withColumns({
        "_judged": judged_form(F.col("rules"), F.col("template")), "_traits": template_traits(F.col("template")),
    })


def violated_constraint(facts: Column, template: Column) -> Column:
    """Error code of the first constraint known facts break."""

    def broken(c: Column) -> Column:
        def judge(pair: Column) -> Column:
            left, right = pair["left"], pair["right"]
            numbers = compare(left["number_value"], c["comparator"], right["number_value"])
            same = left["category_value"] == right["category_value"]
            words = F.when(c["comparator"] == "=", same).when(c["comparator"] == "!=", ~same).otherwise(F.lit(False))
            mixed = left["number_value"].isNotNull() != right["number_value"].isNotNull()
            both = F.coalesce(_known(left) & _known(right), F.lit(False))
            holds = F.when(left["number_value"].isNotNull(), numbers).otherwise(words)
            return both & (mixed | ~F.coalesce(holds, F.lit(False)))

        return let(F.struct(facts[c["left_fact_key"]].alias("left"), facts[c["right_fact_key"]].alias("right")), judge)

    return F.get(F.filter(template["constraints"], broken), F.lit(0))["error_code"]


def resolve(df: DataFrame) -> DataFrame:
    """Resolve rows holding a nested rule set and extracted facts.

    Adds ``resolution_status``, ``reason``, ``outcome_value``,
    ``conditional_outcomes`` and ``source_passage_ids``. The rules are judged
    once inside one expression, so nothing nested is written in between, and
    not at all where the set or the facts have settled the row before.
    """
    t, facts = F.col("template"), F.col("facts")
    problem = F.col("problem") if "problem" in df.columns else rule_set_problem()
    rules = F.col("_judged") if "_judged" in df.columns else judged_form(F.col("rules"), t)

    def requirements(rule: Column) -> Column:
        open_groups = F.filter(rule["groups"], lambda g: eval_group(g, facts).isNull())
        unknown = lambda g: F.filter(g, lambda c: eval_condition(c, facts).isNull())
        return F.transform(open_groups, lambda g: F.transform(unknown(g), lambda c: c["condition"]))

    def reachable_outcomes(judged: Column, outcome: Column) -> Column:
        larger = F.filter(judged, lambda j: j["holds"].isNull() & (j["rule"]["outcome_value"] > outcome))
        shaped = F.transform(
            larger,
            lambda j: F.struct(
                j["rule"]["outcome_value"].alias("outcome_value"), j["rule"]["i"].alias("i"), requirements(j["rule"]).alias("requirement_groups")
            ),
        )
        return F.filter(F.array_sort(shaped), lambda o: F.size(o["requirement_groups"]) > 0)

    # A fact the template names but nobody extracted counts as missing too.
    all_missing = ~F.coalesce(F.exists(t["facts"], lambda f: F.coalesce(_known(facts[f["fact_key"]]), F.lit(False))), F.lit(False))
    before = F.coalesce(
        F.when(F.col("facts_status") == "invalid", "invalid_question_facts").when(F.col("facts_status") == "conflicting", "conflicting_question_facts"),
        violated_constraint(facts, t),
        F.when(all_missing, "missing_question_facts"),
    )

    def concluded(status: object, reason: object, outcome: object = None, reach: object = None, sources: object = None) -> Column:
        column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(
            column(status).alias("resolution_status"), column(reason).cast("string").alias("reason"), column(outcome).cast("double").alias("outcome_value"),
            (F.array().cast(OUTCOMES) if reach is None else reach).alias("conditional_outcomes"),
            (F.array().cast("array<string>") if sources is None else sources).alias("source_passage_ids"),
        )

    def conclude(judged: Column, outcome: Column, reach: Column) -> Column:
        chosen = F.filter(judged, lambda j: F.coalesce(j["holds"], F.lit(False)) & (j["rule"]["outcome_value"] == outcome))
        reached = let(reach["outcome_value"], lambda values: F.filter(judged, lambda j: F.array_contains(values, j["rule"]["outcome_value"])))
        cited = F.when(F.size(reach) == 0, chosen).otherwise(F.concat(chosen, reached))
        sources = F.array_distinct(F.flatten(cited["rule"]["sources"]))
        return concluded(F.when(F.size(reach) > 0, "conditional").otherwise("resolved"), None, outcome, reach, sources)

    judged = F.transform(rules, lambda r: F.struct(r.alias("rule"), eval_rule(r, facts).alias("holds")))
    best = lambda js: F.array_max(F.filter(js, lambda j: F.coalesce(j["holds"], F.lit(False)))["rule"]["outcome_value"])

    def weigh(js: Column, top: Column) -> Column:
        return (
            F.when(top.isNull(), concluded("blocked", "no_applicable_rule"))
            .when(F.col("aggregation_strategy") != STRATEGY, concluded("blocked", "unsupported_aggregation_strategy"))
            .otherwise(let(reachable_outcomes(js, top), lambda r: conclude(js, top, r)))
        )

    judging = let(judged, lambda js: let(best(js), lambda top: weigh(js, top)))
    asking = let(before, lambda b: F.when(b.isNotNull(), concluded("needs_clarification", b)).otherwise(judging))
    resolution = F.when(problem.isNotNull(), concluded("blocked", problem)).otherwise(asking)
    return df.withColumn("_resolution", resolution).select("*", "_resolution.*").drop("_resolution")


def _requirement(c: Column) -> Column:
    age = c["fact_key"] == "age_years"
    subject = F.when(age, "tu as").otherwise("tu comptes")
    unit = F.when(age, "ans").otherwise("ans de service dans la même institution")
    amount = reduce(lambda acc, kv: acc.when(c["comparator"] == kv[0], kv[1]), list(REQUIREMENT.items())[1:],
                    F.when(c["comparator"] == ">=", REQUIREMENT[">="]))
    value = F.coalesce(number_text(c["number_value"]), c["category_value"])
    return F.concat_ws(" ", subject, amount, value, unit)


def render(df: DataFrame) -> DataFrame:
    """Add ``answer``, ``result`` and ``needs_human_review`` in the template's words."""
    outcome, facts, t = F.col("outcome_value"), F.col("facts"), F.col("template")
    said = number_text(outcome)
    age = facts["age_years"]["number_value"]
    days = F.concat(F.lit("u as droit à "), said, F.lit(" jours de vacances."))
    opening = F.concat(F.when(age.isNull(), "T").otherwise(F.concat(F.lit("À "), number_text(age), F.lit(" ans, t"))), days)
    sentence = F.transform(
        "conditional_outcomes",
        lambda o: F.concat(
            F.lit("Si "),
            F.array_join(F.transform(o["requirement_groups"], lambda g: F.array_join(F.transform(g, _requirement), " et ")), " ou "),
            F.lit(", tu as droit à "), number_text(o["outcome_value"]), F.lit(" jours."),
        ),
    )
    annual = F.array_join(F.concat(F.array(opening), sentence), " ")
    motive = facts["leave_reason"]["category_value"]
    label = F.coalesce(
        reduce(lambda acc, kv: acc.when(motive == kv[0], kv[1]), list(REASON_LABELS.items())[1:], F.when(motive == "marriage", REASON_LABELS["marriage"])),
        F.lit("ce motif"),
    )
    exceptional = F.concat(F.lit("Pour "), label, F.lit(", tu as droit à "), said, F.lit(" jour"), F.when(outcome > 1, "s").otherwise(""), F.lit("."))
    known = t["renderer_key"].isin(*REGISTRY["renderer"])
    blocked = (F.col("resolution_status") == "blocked") | (outcome.isNull() & (F.col("resolution_status") != "needs_clarification"))
    clarify = (F.col("resolution_status") == "needs_clarification") | (
        ~blocked & (t["renderer_key"] == "exceptional_leave_answer_fr_v1") & motive.isNull()
    )
    result = F.when(known, F.when(clarify, "needs_clarification").when(blocked, "insufficient_sources").otherwise("supported"))
    answer = F.when(clarify, t["clarification"]).when(blocked, BLOCKED).when(t["renderer_key"] == "annual_leave_answer_fr_v1", annual).otherwise(exceptional)
    return df.withColumns({"result": result, "answer": F.when(known, answer), "needs_human_review": F.when(known, blocked & ~clarify)})


def registry_mismatch(template: Column) -> Column:
    """First key a template names that the runtime does not have, or null."""
    stray = F.filter(template["facts"], lambda f: ~f["extractor_key"].isin(*REGISTRY["fact_extractor"]))
    return F.coalesce(
        F.when(~template["detector_key"].isin(*REGISTRY["intent_detector"]), template["detector_key"]),
        F.when(~template["renderer_key"].isin(*REGISTRY["renderer"]), template["renderer_key"]),
        F.when(~template["aggregation_strategy"].isin(*REGISTRY["aggregation_strategy"]), template["aggregation_strategy"]),
        F.get(stray, F.lit(0))["extractor_key"],
    )


def _answered(joined: DataFrame) -> DataFrame:
    out = render(resolve(joined))
    missing = F.col("_stray") | F.col("result").isNull()
    code = (
        F.when(missing, "rag_runtime_registry_mismatch")
        .when(F.col("reason").isNotNull(), F.concat(F.lit("deterministic_"), "reason"))
        .when(F.col("resolution_status") == "needs_clarification", "deterministic_needs_clarification")
    )
    return out.withColumn("_missing", missing).withColumns(
        {
            "error_code": code,
            "result": F.when(F.col("_missing"), "insufficient_sources").otherwise(F.col("result")),
            "answer": F.when(F.col("_missing"), BLOCKED).otherwise(F.col("answer")),
            "needs_human_review": F.col("_missing") | F.coalesce("needs_human_review", F.lit(False)),
            "source_passage_ids": F.when(F.col("_missing"), F.array().cast("array<string>")).otherwise(F.col("source_passage_ids")),
        }
    ).drop("_missing")


def answer_by_rules(questions: DataFrame, sets: DataFrame, tenant: str = "institution_id") -> DataFrame:
    """Answer every question that is about a template its tenant has rules for.

    Exactly one set must match; several are ambiguous and block the answer. Questions are read once, then joined once to one row per
    tenant and template that holds the number of sets and one of them.
    """
    asked = read_questions(questions)
    usable = prepare_rule_sets(sets).withColumnRenamed("rule_key", "template_key").withColumn("_stray", registry_mismatch(F.col("template")).isNotNull())
    fields = [c for c in usable.columns if c not in (tenant, "template_key")]
    matching = usable.groupBy(tenant, "template_key").agg(F.count(F.lit(1)).alias("matching_sets"), F.first(F.struct(*fields)).alias("_set"))
    joined = asked.join(matching, [tenant, "template_key"]).select("*", "_set.*").drop("_set")
    keep = [*questions.columns, "template_key", "result", "answer", "needs_human_review", "error_code", "source_passage_ids",
            "resolution_status", "outcome_value"]
    ambiguous = {
        "result": F.lit("insufficient_sources"), "answer": F.lit(BLOCKED), "needs_human_review": F.lit(True),
        "error_code": F.lit("deterministic_rule_ambiguous"), "source_passage_ids": F.array().cast("array<string>"),
        "resolution_status": F.lit("blocked"), "outcome_value": F.lit(None).cast("double"),
    }
    out = _answered(extract_facts(joined))
    return out.withColumns({name: F.when(F.col("matching_sets") > 1, value).otherwise(F.col(name)) for name, value in ambiguous.items()}).select(*keep)


def what_if(simulations: DataFrame, sets: DataFrame, intent: str | None = None) -> DataFrame:
    """Outcome of each (rule_set_id, question) row as if the set were in force; nothing is changed.

    A set is validated once, before questions meet it. ``intent`` names the column of that name if :func:`read_questions` has
    read the questions before; they are not read again then.
    """
    in_force = prepare_rule_sets(sets.withColumns({"persisted_status": F.col("status"), "status": F.lit("validated"), "document_status": F.lit("active")}))
    in_force = in_force.withColumns({"_stray": registry_mismatch(F.col("template")).isNotNull(), "_owned": F.flatten(F.transform("rules", lambda r: r["sources"]))})
    read = simulations.withColumnRenamed(intent, "_intent") if intent else read_questions(simulations, intent="_intent", every=True)
    joined = read.join(in_force, "rule_set_id").withColumn("template_key", F.col("rule_key"))
    out = render(resolve(extract_facts(joined)))
    code = first_match(
        (F.col("reason").isin("invalid_template_binding", "invalid_rule", "duplicate_template_fact", "invalid_fact_constraint"), "invalid_rule_contract"),
        (F.col("_stray"), "runtime_registry_mismatch"),
        (~F.col("_intent").eqNullSafe(F.col("rule_key")), "question_outside_template"),
        (F.col("result").isNull(), "renderer_unavailable"),
        (F.size(F.array_except("source_passage_ids", "_owned")) > 0, "simulation_source_mismatch"),
    )
    recognised = F.size(F.filter(F.map_values("facts"), _known))
    return out.withColumns({"code": F.coalesce(code, F.col("resolution_status")), "recognized_fact_count": recognised}).drop("_intent", "mentions", "_stray", "_owned", "_judged")


# The two published templates.
ANNUAL_TEMPLATE = {
    "template_version_id": "f0a00000-0000-4000-8000-000000000001", "template_key": ANNUAL_LEAVE, "aggregation_strategy": STRATEGY,
    "result_unit": "days", "result_value_type": "number", "result_integer_only": True, "result_minimum": 0.0, "result_maximum": 10000.0,
    "detector_key": "annual_leave_intent_v1", "renderer_key": "annual_leave_answer_fr_v1",
    "clarification": "J’ai besoin de ton âge et de ton nombre d’années de service dans la même institution pour déterminer ce droit.",
    "facts": [
        {"fact_key": "age_years", "value_type": "number", "extractor_key": "age_years_fr_v1", "minimum_number": 14.0, "maximum_number": 100.0,
         "integer_only": True, "operators": ["<", ">="], "categories": []},
        {"fact_key": "service_years", "value_type": "number", "extractor_key": "service_years_fr_v1", "minimum_number": 0.0,
         "maximum_number": 80.0, "integer_only": True, "operators": [">="], "categories": []},
    ],
    "constraints": [{"constraint_key": "service_not_greater_than_age", "left_fact_key": "service_years", "comparator": "<=",
                     "right_fact_key": "age_years", "error_code": "impossible_question_facts"}],
}
EXCEPTIONAL_TEMPLATE = {
    "template_version_id": "f0a00000-0000-4000-8000-000000000002", "template_key": EXCEPTIONAL_LEAVE, "aggregation_strategy": STRATEGY,
    "result_unit": "days", "result_value_type": "number", "result_integer_only": True, "result_minimum": 0.0, "result_maximum": 30.0,
    "detector_key": "exceptional_leave_intent_v1", "renderer_key": "exceptional_leave_answer_fr_v1",
    "clarification": "De quel motif de congé exceptionnel s’agit-il : mariage ou partenariat enregistré, décès d’un parent au premier degré, "
    "décès d’un parent au deuxième degré, ou déménagement ?",
    "facts": [{"fact_key": "leave_reason", "value_type": "category", "extractor_key": "leave_reason_fr_v1", "minimum_number": None,
               "maximum_number": None, "integer_only": False, "operators": ["="],
               "categories": ["marriage", "death_first_degree", "death_second_degree", "moving"]}],
    "constraints": [],
}
# The reference rules of each template as (outcome, fact, comparator, value).
ANNUAL_RULES = ((25, None, None, None), (30, "age_years", "<", 20), (30, "age_years", ">=", 50), (30, "service_years", ">=", 15),
                (35, "age_years", ">=", 60), (35, "service_years", ">=", 25))
EXCEPTIONAL_RULES = ((1, None, None, None), (3, "leave_reason", "=", "marriage"), (2, "leave_reason", "=", "death_second_degree"),
                     (5, "leave_reason", "=", "death_first_degree"))


def template_column(spec: dict) -> Column:
    import json

    return F.from_json(F.lit(json.dumps(spec)), TEMPLATE)


def rule_column(set_id: Column, number: int, outcome: Column, fact: str | None, comparator: str | None, value: object, sources: Column) -> Column:
    """One rule of a nested set, with at most one condition."""
    numeric = isinstance(value, (int, float))
    cond = F.struct(
        F.lit(fact).alias("fact_key"), F.lit("number" if numeric else "category").alias("fact_value_type"), F.lit(comparator).alias("comparator"),
        F.lit(float(value) if numeric else None).cast("double").alias("number_value"),
        F.lit(None if numeric else value).cast("string").alias("category_value"),
    )
    groups = F.array(F.array(cond)) if fact else F.array().cast(f"array<array<{CONDITION}>>")
    return F.struct(
        F.concat_ws("-", set_id, F.lit(str(number))).alias("rule_id"), outcome.cast("double").alias("outcome_value"), F.lit(fact is None).alias("is_default"),
        F.lit(f"Règle {number}").alias("label"), groups.cast(f"array<array<{CONDITION}>>").alias("groups"), sources.alias("sources"),
    ).cast(RULE)
