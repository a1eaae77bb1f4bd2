import json

from pyspark.sql import functions as F

from agoradesk.operators import answers as an
from agoradesk.operators import retrieval as rt

A, B = "11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"


def raw(**changes):
    body = {"result": "supported", "answer": "Oui.", "used_passage_ids": [A], "needs_human_review": False, **changes}
    return json.dumps({k: v for k, v in body.items() if v is not ...}, ensure_ascii=False)


def test_contract(spark):
    cases = {
        "ok": (raw(), True), "extra": (raw(extra=1), False), "no ids": (raw(used_passage_ids=[]), False), "bad id": (raw(used_passage_ids=["x"]), False),
        "clarify": (raw(result="needs_clarification", used_passage_ids=[]), True), "clarify with ids": (raw(result="needs_clarification"), False),
        "insufficient": (json.dumps({"result": "insufficient_sources", "x": 1}), True), "other": (raw(result="maybe"), False), "broken": ("{", False),
        "long": (raw(answer="x" * 4001), False), "empty": (raw(answer="  "), False), "flag": (raw(needs_human_review="no"), False), "array": ("[]", False),
        "missing": (raw(answer=...), False),
    }
    rows = an.parse_answers(spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, raw string")).collect()
    assert {r.k: r.contract_ok for r in rows} == {k: v[1] for k, v in cases.items()}
    canon = next(r for r in rows if r.k == "insufficient")
    assert canon.answer == an.INSUFFICIENT and canon.used_passage_ids == []


def test_sanitized_answer(spark):
    text = f"Tu as droit à 3 jours (source : passage_id: **{A}**) , voir passage_id={B} ."
    got = spark.createDataFrame([(text,)], "t string").select(an.sanitize_answer(F.col("t")).alias("v")).first().v
    assert got == "Tu as droit à 3 jours, voir."


def test_salvage(spark):
    cases = {
        "```json\n{\"a\": \"x\ty\"}\n```": {"a": "x\ty"}, "avant {\"a\": {\"b\": \"}\"}} après {": {"a": {"b": "}"}}, "rien": None, "{\"a\": \"ouvert}": None,
        "{\"a\": \"l1\nl2\\n\"}": {"a": "l1\nl2\n"},
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", an.salvage_json(F.col("t"), F.lit(True)).alias("v")).collect()
    for r in rows:
        assert (None if r.v is None else json.loads(r.v)) == cases[r.t], r.t


def test_numeric_tokens(spark):
    cases = {
        "10-20 % et 3,0 jours": ["10", "-20|%", "3|jours"], "1 jour": ["1|jour"], "vingt et un jours": ["words|vingt et un jours"], "aucun": [],
        "dix-sept  semaines, 2.50 CHF": ["2.5|chf", "words|dix-sept semaines"],
    }
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", an.numeric_tokens(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == cases


def test_audit_decisions(spark):
    passages = spark.createDataFrame([(A, "17 semaines de congé"), (B, "3 jours par cas, 35 heures")], "passage_id string, content string")
    answers = spark.createDataFrame(
        [("grounded", "supported", "17 semaines", [A]), ("ungrounded", "supported", "18 semaines", [A]), ("absent", "supported", "oui", [A, "x"]),
         ("protected", "supported", "3 jours", [B]), ("other unit", "supported", "35 heures", [B]), ("no number", "supported", "selon le cas", [B]),
         ("vague", "needs_clarification", "Peux-tu préciser ta situation ?", []), ("numeric", "needs_clarification", "Plus de 50 ans ?", []),
         ("good question", "needs_clarification", "Quel est ton âge ?", []), ("conflict", "conflicting_sources", "17 semaines", [A])],
        "answer_id string, result string, answer string, used_passage_ids array<string>").withColumn("needs_human_review", F.lit(False))
    sources = answers.select("answer_id").join(an.evidence_tokens(passages).select("passage_id", "evidence"))
    protected = spark.createDataFrame([(B, "days")], "passage_id string, result_unit string")
    out = {r.answer_id: (r.client_result, r.error_code) for r in an.audit_answers(answers, sources, protected.limit(0), protected).collect()}
    bad = "insufficient_sources"
    assert out == {
        "grounded": ("supported", None), "ungrounded": (bad, "ungrounded_numeric_answer"), "absent": (bad, "invalid_citation"),
        "protected": (bad, "deterministic_rule_required"), "other unit": ("supported", None), "no number": (bad, "deterministic_rule_required"),
        "vague": (bad, "needs_clarification_vague_rejected"), "numeric": (bad, "needs_clarification_numeric_rejected"),
        "good question": ("needs_clarification", "needs_clarification"), "conflict": ("conflicting_sources", "conflicting_sources"),
    }
    loose = an.audit_answers(answers, sources, protected, protected.limit(0))
    assert {r.answer_id: r.error_code for r in loose.collect()}["protected"] == "deterministic_rule_required"


def test_excerpt(spark):
    long = "préambule " * 80 + "le congé maternité dure 17 semaines au total " + "suite " * 80
    rows = spark.createDataFrame([(long, "La maternité dure 17 semaines"), ("court  texte", "x")], "c string, f string").select(rt.excerpt(F.col("c"), F.col("f")).alias("e")).collect()
    assert "17 semaines" in rows[0].e and len(rows[0].e) <= 402 and rows[0].e.startswith("…") and rows[0].e.endswith("…")
    assert rows[1].e == "court texte"


def test_tokens_of_long_digits_and_long_runs_of_number_words(spark):
    run = "un deux " * 10_000
    texts = ["9" * 50 + " jours", "12345678901234567890", "9" * 400, run, run + "jours et trois", "cinq pour cent francs", "vingt et un jours, une-deux heures, quatre-vingts ans", "deux trois mois six"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", an.numeric_tokens(F.col("t")).alias("t")).orderBy("n").collect()
    found = [r.t for r in rows]
    assert found[0] == ["1" + "0" * 50 + "|jours"] and found[1] == ["12345678901234567000"] and found[2] == ["Infinity"]
    assert found[3] == [] and found[4] == ["words|" + run + "jours"] and found[5] == ["words|cinq pour cent"]
    assert found[6] == ["words|vingt et un jours", "words|une-deux heures", "words|quatre-vingts ans"] and found[7] == ["words|deux trois mois"]
    from agoradesk.operators import questions as qs

    said = spark.createDataFrame([(run,), (run + "jours",)], "t string").select(qs.needs_rules(F.lit("x"), F.col("t")).alias("s"))
    assert [r.s for r in said.collect()] == [False, True]
