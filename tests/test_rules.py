import re

import pytest
from pyspark.sql import functions as F

from agoradesk.functions.text import fold
from agoradesk.operators import questions as qs
from agoradesk.operators import rules as rl


def rule_set(spec, base, sources=("s",)):
    rules = F.array(*[rl.rule_column(F.lit("set"), i, F.lit(o), f, c, v, F.array(F.lit(f"p{i}"))) for i, (o, f, c, v) in enumerate(base)])
    return [
        F.lit("set-" + spec["template_key"]).alias("rule_set_id"), F.lit("h1").alias("institution_id"), F.lit(spec["template_key"]).alias("rule_key"),
        F.lit(spec["template_version_id"]).alias("template_version_id"), F.lit(rl.STRATEGY).alias("aggregation_strategy"), F.lit("days").alias("result_unit"),
        F.lit("validated").alias("status"), F.lit("active").alias("document_status"), rules.alias("rules"), rl.template_column(spec).alias("template"),
    ]


@pytest.fixture(scope="module")
def sets(spark):
    one = spark.range(1)
    return one.select(*rule_set(rl.ANNUAL_TEMPLATE, rl.ANNUAL_RULES)).unionByName(one.select(*rule_set(rl.EXCEPTIONAL_TEMPLATE, rl.EXCEPTIONAL_RULES)))


CASES = {
    "J'ai 58 ans, combien de vacances ?": ("conditional", 30.0, None),
    "J'ai 58 ans et 25 ans de service, combien de vacances ?": ("resolved", 35.0, None),
    "J'ai 19 ans, vacances ?": ("resolved", 30.0, None),
    "Vacances : j'ai 50 ans": ("conditional", 30.0, None),
    "Vacances : j'ai 60 ans": ("resolved", 35.0, None),
    "Combien de vacances avec 15 ans de service ?": ("conditional", 30.0, None),
    "Combien de vacances avec 25 ans d'ancienneté ?": ("resolved", 35.0, None),
    "J'ai 58,5 ans, combien de vacances ?": ("needs_clarification", None, "deterministic_invalid_question_facts"),
    "J'ai 30 ans et 35 ans de service, vacances ?": ("needs_clarification", None, "deterministic_impossible_question_facts"),
    "Combien de vacances ?": ("needs_clarification", None, "deterministic_missing_question_facts"),
    "Quel congé pour mon mariage ?": ("resolved", 3.0, None),
    "Quel congé pour le décès de ma mère ?": ("resolved", 5.0, None),
    "Quel congé pour le décès de mon grand-père ?": ("resolved", 2.0, None),
    "Je déménage, combien de jours ?": ("resolved", 1.0, None),
    "Mariage de mon frère : combien de jours ?": ("needs_clarification", None, "deterministic_missing_question_facts"),
}


def test_fixed_cases(spark, sets):
    asked = spark.createDataFrame([("h1", q) for q in CASES], "institution_id string, question string")
    out = {r.question: r for r in rl.answer_by_rules(asked, sets).collect()}
    for q, (status, value, code) in CASES.items():
        assert (out[q].resolution_status, out[q].outcome_value, out[q].error_code) == (status, value, code), q
    assert out["J'ai 58 ans, combien de vacances ?"].answer == (
        "À 58 ans, tu as droit à 30 jours de vacances. Si tu comptes au moins 25 ans de service dans la même institution, tu as droit à 35 jours.")
    assert out["Quel congé pour mon mariage ?"].answer == "Pour un mariage ou un partenariat enregistré, tu as droit à 3 jours."
    # What-if sources take in every rule with a reachable value, even one that does not hold.
    assert out["J'ai 58 ans, combien de vacances ?"].source_passage_ids == ["p2", "p4", "p5"]


def test_ambiguous_and_simulated(spark, sets):
    asked = spark.createDataFrame([("h1", "J'ai 40 ans, combien de vacances ?")], "institution_id string, question string")
    twice = sets.unionByName(sets.withColumn("rule_set_id", F.lit("other")))
    row = rl.answer_by_rules(asked, twice).first()
    assert (row.error_code, row.result, row.answer) == ("deterministic_rule_ambiguous", "insufficient_sources", rl.BLOCKED)
    sims = spark.createDataFrame([("set-annual_leave_days", "J'ai 40 ans, vacances ?"), ("set-annual_leave_days", "Mon mariage ?")], "rule_set_id string, question string")
    got = {r.question: (r.code, r.recognized_fact_count) for r in rl.what_if(sims, sets.withColumn("status", F.lit("proposed"))).collect()}
    assert got == {"J'ai 40 ans, vacances ?": ("conditional", 1), "Mon mariage ?": ("question_outside_template", 0)}


def test_three_valued_logic(spark):
    values = {"t": True, "f": False, "u": None}
    rows = [(a + b, values[a], values[b]) for a in values for b in values]
    df = spark.createDataFrame(rows, "k string, a boolean, b boolean").select(
        "k", F.forall(F.array("a", "b"), lambda x: x).alias("all"), F.exists(F.array("a", "b"), lambda x: x).alias("any"))
    for r in df.collect():
        a, b = values[r.k[0]], values[r.k[1]]
        assert r["all"] == (False if False in (a, b) else None if None in (a, b) else True)
        assert r["any"] == (True if True in (a, b) else None if None in (a, b) else False)


def test_routing(spark):
    want = {
        "Combien de jours de congé ?": qs.TYPE_CLARIFICATION, "congé": qs.TYPE_CLARIFICATION, "Quels types de congé existent ?": None,
        "Procédure de congé": None, "Congé pour deuil d'un proche : combien ?": qs.RELATION_CLARIFICATION,
        "Congé pour le deuil de mon oncle, combien de jours ?": None, "Congé maladie combien de jours": None, "Combien de congés payés ?": None,
        "Combien de jours de salaire ?": None,
    }
    rows = spark.createDataFrame([(q,) for q in want], "q string").select("q", qs.route_question(fold(F.col("q"))).alias("r")).collect()
    assert {r.q: r.r for r in rows} == want


def own(spec, **changes):
    return {**spec, "facts": [{**f, **changes.get(f["fact_key"], {})} for f in spec["facts"]]}


def facts_of(spark, spec, questions):
    rows = spark.createDataFrame([(q,) for q in questions], "question string")
    out = qs.extract_facts(qs.read_questions(rows, every=True).withColumn("template", rl.template_column(spec)))
    return {r.question: r for r in out.collect()}


def test_fact_extraction(spark):
    want = {
        "j'ai 30 ans": (30.0, "ok"), "a 30 ans de service": (None, "ok"), "age : 30 ans et agé de 31 ans": (None, "conflicting"), "j'ai 130 ans": (None, "invalid"),
        "un employé de 45 ans": (45.0, "ok"), "45 ans d'age": (45.0, "ok"), "xa 30 ans": (None, "ok"),
    }
    got = facts_of(spark, own(rl.ANNUAL_TEMPLATE), want)
    assert {q: (r.facts["age_years"].number_value, r.facts["age_years"].status) for q, r in got.items()} == {q: v for q, v in want.items()}


def test_facts_follow_the_template(spark):
    adult = own(rl.ANNUAL_TEMPLATE, age_years={"minimum_number": 18.0})
    got = facts_of(spark, adult, ["J'ai 16 ans, vacances ?", "J'ai 18 ans, vacances ?", "vacances", None])
    assert (got["J'ai 16 ans, vacances ?"].facts_status, got["J'ai 16 ans, vacances ?"].facts_errors) == ("invalid", ["age_years_out_of_range"])
    assert got["J'ai 18 ans, vacances ?"].facts["age_years"].number_value == 18.0
    assert got["vacances"].facts_status == "ok" and got[None].facts_status == "ok"
    half = facts_of(spark, own(rl.ANNUAL_TEMPLATE, age_years={"integer_only": False, "maximum_number": None}), ["J'ai 58,5 ans", "J'ai 130 ans"])
    assert half["J'ai 58,5 ans"].facts["age_years"].number_value == 58.5 and half["J'ai 130 ans"].facts_status == "ok"
    few = facts_of(spark, own(rl.EXCEPTIONAL_TEMPLATE, leave_reason={"categories": ["marriage"]}), ["Je déménage", "Mon mariage et le décès de mon père"])
    assert few["Je déménage"].facts["leave_reason"].category_value is None
    assert few["Mon mariage et le décès de mon père"].facts["leave_reason"].category_value == "marriage"
    one = {**rl.ANNUAL_TEMPLATE, "facts": rl.ANNUAL_TEMPLATE["facts"][1:]}
    assert list(facts_of(spark, one, ["J'ai 30 ans"])["J'ai 30 ans"].facts) == ["service_years"]
    odd = facts_of(spark, own(rl.ANNUAL_TEMPLATE, age_years={"extractor_key": "size_v1"}), ["J'ai 30 ans"])["J'ai 30 ans"]
    assert (odd.facts, odd.facts_status, odd.facts_errors) == (None, "invalid", ["unknown_extractor_size_v1"])


def test_answers_and_plan_follow_the_template(spark):
    adult = own(rl.ANNUAL_TEMPLATE, age_years={"minimum_number": 18.0})
    sets = spark.range(1).select(*rule_set(adult, rl.ANNUAL_RULES))
    asked = spark.createDataFrame([("h1", "J'ai 16 ans, combien de vacances ?")], "institution_id string, question string")
    out = rl.answer_by_rules(asked, sets)
    row = out.first()
    assert (row.resolution_status, row.error_code) == ("needs_clarification", "deterministic_invalid_question_facts")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("employe?") == 1


def test_consolidated_turns(spark):
    turns = spark.createDataFrame([(1, 0, "Combien de congés ?"), (1, 2, "J'ai 30 ans"), (1, 4, "x"), (1, 6, "Et 5 ans de service"), (2, 0, "y" * 999)] +
                                  [(2, i, "z" * 900) for i in range(1, 8)], "c int, n int, t string")
    out = {(r.c, r.n): r.effective_question for r in qs.effective_questions(turns, "c", "n", "t").collect()}
    assert out[1, 0] == "Combien de congés ?"
    assert out[1, 6] == "Question initiale : Combien de congés ?\nComplément de l’utilisateur : J'ai 30 ans\nComplément de l’utilisateur : Et 5 ans de service"
    assert (1, 4) not in out and out[2, 7] is None and len(out[2, 4]) <= 5100


def test_whole_turns_keep_every_text(spark):
    texts = {(1, 0): "Combien ?", (1, 1): "x", (1, 2): "y" * 1500, (1, 3): None, (2, 0): "a" * 6000, (2, 1): " fin  ici "}
    turns = spark.createDataFrame([(*k, t) for k, t in texts.items()], "c int, n int, t string")
    out = {(r.c, r.n): r for r in qs.whole_questions(turns, "c", "n", "t").collect()}
    assert set(out) == set(texts) and [out[1, k].turn_number for k in range(4)] == [1, 2, 3, 4]
    assert [out[1, k].question_status for k in range(4)] == ["ok", "too_short", "too_long", "too_short"]
    assert out[1, 0].effective_question == "Combien ?" and out[2, 0].effective_question == "a" * 6000 and out[2, 0].effective_status == "ok"
    assert out[1, 3].effective_question == f"{qs.FIRST_TURN}Combien ?\n{qs.NEXT_TURN}x\n{qs.NEXT_TURN}" + "y" * 1500
    assert out[2, 1].effective_question == f"{qs.FIRST_TURN}{'a' * 6000}\n{qs.NEXT_TURN}fin ici" and out[2, 1].effective_status == "too_long"


def test_durations_are_summed_as_logged_as_well(spark):
    from agoradesk.operators import reporting

    rows = [(1, d, "supported", None, 1, 0.5) for d in (400_000.0, 100.0)]
    log = spark.createDataFrame(rows, "k int, duration_ms double, result string, error_code string, passages_used int, similarity double")
    row = reporting.request_log_summary(log, ["k"]).first()
    assert (row.duration_ms, row.unclamped_duration_ms) == (300_100, 400_100)


def test_sets_are_validated_before_questions_meet_them(spark, sets):
    sims = spark.range(2).select(F.lit("J'ai 30 ans, vacances ?").alias("question"), F.lit("set-annual_leave_days").alias("rule_set_id"))
    plan = rl.what_if(sims, sets)._jdf.queryExecution().analyzed().toString()
    above, below = plan.split("Join", 1)
    assert "invalid_default_rule_count" in below and "invalid_default_rule_count" not in above


def test_what_if_reads_a_question_once_and_in_compiled_steps(spark, sets):
    rows = [(i, q, "set-annual_leave_days") for i, q in enumerate(["J'ai 30 ans, vacances ?", "Mon mariage ?", "Bonjour", None])]
    asked = spark.createDataFrame(rows, "id long, question string, rule_set_id string")
    read = qs.read_questions(asked).where("template_key is not null")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("employe?") == 1 and plan.count("vacances?(") == 1
    out = rl.what_if(read, sets, intent="template_key")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("employe?") == 1
    assert {(r.id, r.code, r.recognized_fact_count) for r in out.collect()} == {(0, "conditional", 1), (1, "question_outside_template", 0)}


def test_all_comparators_in_judged_form(spark):
    signs = ("=", "!=", "<", "<=", ">", ">=", "~", None)
    values = (None, 1.0, 2.0, 3.0, float("nan"))
    rows = [(s, v, n) for s in signs for v in values for n in values]
    df = spark.createDataFrame(rows, "comparator string, said double, n double")
    rule = lambda **v: F.array(F.struct(
        F.lit("r").alias("rule_id"), F.lit(1.0).alias("outcome_value"), F.lit(False).alias("is_default"), F.lit("").alias("label"),
        F.array(F.array(F.struct(*[c.alias(k) for k, c in v.items()]))).alias("groups"), F.array(F.lit("p")).alias("sources")))
    number = rule(fact_key=F.lit("age_years"), fact_value_type=F.lit("number"), comparator=F.col("comparator"), number_value=F.col("n"), category_value=F.lit(None).cast("string"))
    fact = F.create_map(F.lit("age_years"), F.struct(F.lit("ok").alias("status"), F.col("said").alias("number_value"), F.lit(None).cast("string").alias("category_value")))
    out = df.withColumns({"f": fact, "t": rl.template_column(rl.ANNUAL_TEMPLATE)}).withColumn("r", rl.judged_form(number.cast(f"array<{rl.RULE}>"), F.col("t"))[0])
    for r in out.select("comparator", "said", "n", rl.eval_rule(F.col("r"), F.col("f")).alias("holds"), rl.compare(F.col("said"), F.col("comparator"), F.col("n")).alias("plain")).collect():
        assert r.holds == (None if r.said is None else bool(r.plain)), r
    rows = [(s, v, n) for s in signs for v in (None, "a", "b") for n in (None, "a")]
    df = spark.createDataFrame(rows, "comparator string, said string, n string")
    named = rule(fact_key=F.lit("leave_reason"), fact_value_type=F.lit("category"), comparator=F.col("comparator"), number_value=F.lit(None).cast("double"), category_value=F.col("n"))
    fact = F.create_map(F.lit("leave_reason"), F.struct(F.lit("ok").alias("status"), F.lit(None).cast("double").alias("number_value"), F.col("said").alias("category_value")))
    out = df.withColumns({"f": fact, "t": rl.template_column(rl.EXCEPTIONAL_TEMPLATE)}).withColumn("r", rl.judged_form(named.cast(f"array<{rl.RULE}>"), F.col("t"))[0])
    for r in out.select("comparator", "said", "n", rl.eval_rule(F.col("r"), F.col("f")).alias("holds")).collect():
        want = r.n is not None and {"=": r.said == r.n, "!=": r.said != r.n}.get(r.comparator, False)
        assert r.holds == (None if r.said is None else want), r


def test_fixed_patterns_find_the_same_with_their_first_character_looked_for(spark):
    fixed = [*qs.ANNUAL, qs.MARRIAGE, qs.OWN_MARRIAGE, qs.DEATH, qs.FIRST_DEGREE, qs.SECOND_DEGREE, qs.MOVING, qs.OWN_MOVING, *qs.AGE_PATTERNS, *qs.SERVICE_PATTERNS]
    texts = [*CASES, "grand-pere mort", "ma belle-mere, pere", "xvacances", "vacance_", "-5 ans de service", "j'ai y travaille depuis 3,5 ans", "travaille depuis 12 annees",
             "ca fait 3 ans que je travaille ici", "agee de 31 ans et 4.5 ans d'age", "a 3 ans d'anciennete", "12 ans d'age, employe de 40 ans", "nous demenageons", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fold(F.col("t")).alias("f"))
    look = r"^\(\?=\[[^]]*\]\)"
    assert all(re.match(look, qs.pattern(p)) for p in fixed)
    for p in fixed:
        with_look, without = qs.pattern(p), re.sub(look, "", qs.pattern(p))
        found = rows.select("t", *[F.regexp_extract_all("f", F.lit(x), F.lit(0)).alias(n) for n, x in (("a", with_look), ("b", without))])
        assert [r for r in found.collect() if r.a != r.b] == [], p
