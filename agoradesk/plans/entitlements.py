"""Rule evaluation: every supplier is a tenant with its own rule sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.operators import questions as qs
from agoradesk.operators import rules as rl
from agoradesk.plans.questioning import FACTS_SQL, asked
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


def own_template(template: dict):
    """The published template with an institution's own bounds and reasons."""
    k = F.col("institution_id")

    def own(f):
        key = f["fact_key"]
        named = F.when(k % 4 == 1, F.array_remove(f["categories"], "moving")).otherwise(f["categories"])
        values = {
            "minimum_number": F.when((key == "age_years") & (k % 2 == 1), F.lit(18.0)).otherwise(f["minimum_number"]),
            "maximum_number": F.when((key == "service_years") & (k % 5 == 4), F.lit(30.0)).otherwise(f["maximum_number"]), "categories": named,
        }
        return F.struct(*[values.get(n, f[n]).alias(n) for n in ("fact_key", "value_type", "extractor_key", "minimum_number", "maximum_number",
                                                                 "integer_only", "operators", "categories")])

    shared = rl.template_column(template)
    return shared.withField("facts", F.transform(shared["facts"], own))


def templates(spark, sf):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("institution_id"))
    both = [s.select("institution_id", F.lit(t["template_key"]).alias("template_key"), own_template(t).alias("template")) for t in (rl.ANNUAL_TEMPLATE, rl.EXCEPTIONAL_TEMPLATE)]
    return both[0].unionByName(both[1])


def one_template(spark, sf, template: dict, base_rules, suffix: str):
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("institution_id"))
    k = F.col("institution_id")
    set_id = F.concat_ws("-", F.lit(suffix), k.cast("string"))
    rules = F.array(*[
        rl.rule_column(set_id, i, F.lit(o) + k % 3, fact, comparator, value, F.array(F.concat_ws("-", F.lit("p"), k.cast("string"), F.lit(str(i)))))
        for i, (o, fact, comparator, value) in enumerate(base_rules)
    ])
    return s.select(
        set_id.alias("rule_set_id"), "institution_id", F.lit(template["template_key"]).alias("rule_key"),
        F.lit(template["template_version_id"]).alias("template_version_id"), F.lit(rl.STRATEGY).alias("aggregation_strategy"),
        F.lit("days").alias("result_unit"), F.when((k % 10 == 8) & F.lit(suffix == "annual"), "approved").otherwise("validated").alias("status"),
        F.lit("active").alias("document_status"), rules.alias("rules"), own_template(template).alias("template"))


def rule_sets(spark, sf):
    annual = one_template(spark, sf, rl.ANNUAL_TEMPLATE, rl.ANNUAL_RULES, "annual")
    twice = one_template(spark, sf, rl.ANNUAL_TEMPLATE, rl.ANNUAL_RULES, "second").where(F.col("institution_id") % 10 == 9)
    special = one_template(spark, sf, rl.EXCEPTIONAL_TEMPLATE, rl.EXCEPTIONAL_RULES, "special")
    return annual.unionByName(twice).unionByName(special)


JUDGED_SQL = "with " + FACTS_SQL + """,
base as (select *, institution_id % 3 d, [25, 30, 30, 30, 35, 35] o,
  [true, f_age < 20, f_age >= 50, case when f_service is null then case when f_age < 15 then false end else f_service >= 15 end, f_age >= 60,
   case when f_service is null then case when f_age < 25 then false end else f_service >= 25 end] h,
  [1, 3, 2, 5] xo, [true, f_reason = 'marriage', f_reason = 'death_second_degree', f_reason = 'death_first_degree'] xh from facts where template_key is not null),
best as (select *, case when template_key = 'annual_leave_days' then list_max([o[i] for i in range(1, 7) if coalesce(h[i], false)]) else list_max([xo[i] for i in range(1, 5) if coalesce(xh[i], false)]) end top from base),
whatif as (select *, case when template_key = 'annual_leave_days' then [i for i in range(1, 7) if h[i] is null and o[i] > top] else [] end w,
  case when template_key = 'annual_leave_days' and institution_id % 10 = 9 then 'deterministic_rule_ambiguous'
   when template_key = 'annual_leave_days' and institution_id % 10 = 8 then 'deterministic_rule_set_not_active'
   when facts_status = 'invalid' then 'deterministic_invalid_question_facts' when facts_status = 'conflicting' then 'deterministic_conflicting_question_facts'
   when f_service > f_age then 'deterministic_impossible_question_facts'
   when f_age is null and f_service is null and f_reason is null then 'deterministic_missing_question_facts' end error_code from best),
texts as (select *, case when error_code in ('deterministic_rule_ambiguous', 'deterministic_rule_set_not_active') then 'blocked' when error_code is not null then 'needs_clarification'
   when len(w) > 0 then 'conditional' else 'resolved' end resolution_status,
  case when f_age is null then 'Tu as droit à ' else 'À ' || f_age || ' ans, tu as droit à ' end || (top + d) || ' jours de vacances.' ||
  array_to_string([case when i in w then ' Si ' || ['', 'tu as moins de 20 ans', 'tu as au moins 50 ans', 'tu comptes au moins 15 ans de service dans la même institution', 'tu as au moins 60 ans',
     'tu comptes au moins 25 ans de service dans la même institution'][i] || ', tu as droit à ' || (o[i] + d) || ' jours.' else '' end for i in range(1, 7)], '') annual_text,
  'Pour ' || case f_reason when 'marriage' then 'un mariage ou un partenariat enregistré' when 'death_first_degree' then 'le décès d''un parent au premier degré'
    when 'death_second_degree' then 'le décès d''un parent au deuxième degré' else 'un déménagement' end || ', tu as droit à ' || (top + d) || ' jour' || case when top + d > 1 then 's' else '' end || '.' special_text,
  case when template_key = 'annual_leave_days' then list_sort(list_distinct([i for i in range(1, 7) if (coalesce(h[i], false) and o[i] = top) or o[i] in [o[j] for j in w]])) else [i for i in range(1, 5) if coalesce(xh[i], false) and xo[i] = top] end src
  from whatif)
"""


@register("rule_answers", JUDGED_SQL + f"""select l_orderkey, l_linenumber, template_key, resolution_status, error_code, case when error_code is null then cast(top + d as double) end outcome_value,
 case resolution_status when 'blocked' then 'insufficient_sources' when 'needs_clarification' then 'needs_clarification' else 'supported' end as result,
 sha256(case when resolution_status = 'blocked' then '{rl.BLOCKED}' when resolution_status = 'needs_clarification' then case when template_key = 'annual_leave_days' then '{rl.ANNUAL_TEMPLATE["clarification"]}' else '{rl.EXCEPTIONAL_TEMPLATE["clarification"]}' end
   when template_key = 'annual_leave_days' then annual_text else special_text end) answer_sha256,
 case when error_code is null then array_to_string(['p-' || institution_id || '-' || (i - 1) for i in src], ',') else '' end sources from texts""")
def rule_answers(spark, sf):
    out = rl.answer_by_rules(asked(spark, sf), rule_sets(spark, sf))
    return out.select("l_orderkey", "l_linenumber", "template_key", "resolution_status", "error_code", "outcome_value", "result",
                      F.sha2("answer", 256).alias("answer_sha256"), F.array_join(F.array_sort("source_passage_ids"), ",").alias("sources"))


@register("rule_what_if", JUDGED_SQL + """select l_orderkey, l_linenumber, case when template_key <> 'annual_leave_days' then 'question_outside_template' else
  case when facts_status <> 'ok' or f_service > f_age or (f_age is null and f_service is null) then 'needs_clarification' when len(w) > 0 then 'conditional' else 'resolved' end end code,
 cast(case when template_key = 'annual_leave_days' then (f_age is not null)::int + (f_service is not null)::int else 0 end as bigint) recognized_fact_count from texts""")
def rule_what_if(spark, sf):
    rows = qs.read_questions(asked(spark, sf)).where("template_key is not null")
    sims = rows.select("l_orderkey", "l_linenumber", "question", "template_key", "mentions",
                       F.concat_ws("-", F.lit("annual"), F.col("institution_id").cast("string")).alias("rule_set_id"))
    return rl.what_if(sims, rule_sets(spark, sf), intent="template_key").select("l_orderkey", "l_linenumber", "code", F.col("recognized_fact_count").cast("long").alias("recognized_fact_count"))


@register("rule_set_problems", """with s as (select s_suppkey k, s_suppkey % 9 m from supplier)
 select k, case m when 0 then 'rule_set_not_active' when 1 then 'invalid_template_binding' when 2 then 'invalid_default_rule_count' when 3 then 'invalid_rule' when 4 then 'conditional_rule_without_group'
  when 5 then 'invalid_condition_group' when 6 then 'default_rule_has_conditions' when 7 then 'invalid_rule' end problem from s""")
def rule_set_problems(spark, sf):
    sets = one_template(spark, sf, rl.ANNUAL_TEMPLATE, rl.ANNUAL_RULES, "annual").withColumn("status", F.lit("validated"))
    m, k = F.col("institution_id") % 9, F.col("institution_id")
    change = lambda r, **v: F.struct(*[(v[n] if n in v else r[n]).alias(n) for n in ("rule_id", "outcome_value", "is_default", "label", "groups", "sources")])
    none = F.array().cast("array<string>")
    bare = F.array().cast(f"array<array<{rl.CONDITION}>>")
    no_fact = F.array(F.array(F.struct(F.lit("height").alias("fact_key"), F.lit("number").alias("fact_value_type"), F.lit(">=").alias("comparator"),
                                       F.lit(1.0).alias("number_value"), F.lit(None).cast("string").alias("category_value")))).cast(f"array<array<{rl.CONDITION}>>")
    broken = F.transform("rules", lambda r, i: change(
        r,
        is_default=F.when((m == 2), F.lit(True)).otherwise(r["is_default"]),
        sources=F.when((m == 3) & (i == 2), none).otherwise(r["sources"]),
        outcome_value=F.when((m == 7) & (i == 1), F.lit(2.5)).otherwise(r["outcome_value"]),
        groups=F.when((m == 4) & (i == 3), bare).when((m == 5) & (i == 4), no_fact).when((m == 6) & (i == 0), no_fact).otherwise(r["groups"]),
    ))
    rows = sets.withColumns({
        "rules": broken, "status": F.when(m == 0, "rejected").otherwise(F.col("status")),
        "result_unit": F.when(m == 1, "hours").otherwise(F.col("result_unit")),
    })
    return rl.validate_rule_sets(rows).select(k.alias("k"), "problem")
