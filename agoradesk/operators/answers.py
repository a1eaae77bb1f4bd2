"""Audit of model answers: output contract, grounding, protected passages, decision."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from agoradesk.functions.columns import first_match, is_uuid, let, number_text, parse_decimal_comma
from agoradesk.functions.regexes import UUID
from agoradesk.functions.text import collapse, js_trim, strip_marks, words
from agoradesk.operators.questions import NUMBER_RUN, pattern
from agoradesk.operators.retrieval import citations
from agoradesk.operators.rules import BLOCKED, RULE_REQUIRED

# Contract, messages, token shapes, generic words, error codes.
RESULTS = ("supported", "insufficient_sources", "conflicting_sources", "needs_clarification")
FIELDS = "answer,needs_human_review,result,used_passage_ids"
MAX_ANSWER, MAX_IDS = 4_000, 20
INSUFFICIENT = "Je ne trouve pas cette information dans les documents disponibles."
IMPRECISE = "Je ne peux pas identifier de façon suffisamment précise l’information manquante à partir des documents disponibles."
UNGROUNDED = "Je ne peux pas confirmer cette valeur à partir des passages cités."
DIGITS = r"([-+]?\d+(?:[.,]\d+)?)\s*(%|jours?|ans?|annees?|semaines?|mois|heures?|chf|francs?)?"
# A run without a unit is matched as well (beside the group), so that none of its words begins a search of its own.
NUMBER_WORDS = rf"\b(?:({NUMBER_RUN}\s+(?:jours?|ans?|semaines?|mois|heures?|pour\s*cent|francs?)\b)|{NUMBER_RUN})"
GENERIC_WORDS = (
    "a", "agit", "approfondir", "approfondis", "as", "au", "aux", "avec", "besoin", "caracteristique", "categorie", "cas", "ce", "cela",
    "cette", "clarifie", "clarifier", "concerne", "concernee", "concernees", "concernes", "confirme", "confirmer", "d", "dans",
    "davantage", "de", "demande", "des", "detail", "detaille", "detailler", "details", "dire", "dois", "document", "documents", "donner",
    "donnee", "donnees", "du", "element", "elements", "en", "est", "et", "explique", "expliquer", "information", "informations", "il",
    "indiquer", "l", "la", "le", "les", "m", "ma", "manque", "manquante", "manquantes", "me", "merci", "mentionne", "mentionnee",
    "mentionnees", "mentionnes", "mon", "peux", "plait", "plus", "pouvez", "pourrais", "pourriez", "precision", "precisions", "preciser",
    "qu", "quelle", "quelles", "quel", "quels", "question", "quoi", "reponse", "reponses", "s", "si", "situation", "svp", "ta", "te",
    "ton", "tu", "type", "un", "une", "veux", "vous",
)
PASSED_ERRORS = (
    "unauthorized", "device_not_activated", "duplicate_request", "rate_limited", "invalid_request", "request_too_large", "forbidden_origin",
)


def sanitize_answer(col: Column) -> Column:
    """Answer text without technical passage references."""
    reference = f"passage_id\\s*(?:[:=]\\s*)?(?:\\*\\*)?{UUID}(?:\\*\\*)?"
    out = F.regexp_replace(col, f"(?i)\\s*\\((?:source\\s*:\\s*)?{reference}\\s*\\)", "")
    out = F.regexp_replace(out, f"(?i)(?<![A-Za-z0-9_]){reference}", "")
    out = F.regexp_replace(out, "[ \\t]{2,}", " ")
    return js_trim(F.regexp_replace(out, "\\s+([,.;:!?])", "$1"))


def _parsed(raw: Column) -> dict[str, Column]:
    v = F.try_parse_json(raw)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("NONE"))
    return {
        "root": F.coalesce(F.schema_of_variant(v), F.lit("INVALID")),
        "keys": F.array_join(F.array_sort(F.when(F.schema_of_variant(v).startswith("OBJECT"), F.json_object_keys(raw))), ","),
        "result_kind": kind("$.result"), "answer_kind": kind("$.answer"), "ids_kind": kind("$.used_passage_ids"),
        "review_kind": kind("$.needs_human_review"),
        "result": F.try_variant_get(v, "$.result", "string"), "answer": F.try_variant_get(v, "$.answer", "string"),
        "ids": F.try_variant_get(v, "$.used_passage_ids", "array<string>"),
        "review": F.try_variant_get(v, "$.needs_human_review", "boolean"),
    }


def parse_answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Judge raw outputs by the four-field contract; rejected rows keep null fields.

    An answer that says the sources are insufficient is always taken, in its canonical form.
    """
    rows = df.withColumn("_p", F.struct(*[c.alias(n) for n, c in _parsed(F.col(raw)).items()]))
    p = F.col("_p")
    rows = rows.withColumn("_clean", sanitize_answer(p["answer"]))
    none_needed = p["result"] == "needs_clarification"
    ok = (
        (p["keys"] == FIELDS) & (p["result_kind"] == "STRING") & p["result"].isin(*RESULTS) & (p["answer_kind"] == "STRING")
        & (F.length(js_trim(p["answer"])) <= MAX_ANSWER) & (F.length("_clean") >= 1) & p["ids_kind"].startswith("ARRAY")
        & (F.size(p["ids"]) <= MAX_IDS) & F.forall(p["ids"], is_uuid) & (p["review_kind"] == "BOOLEAN")
        & (none_needed == (F.size(p["ids"]) == 0))
    )
    insufficient = (p["result"] == "insufficient_sources") & p["root"].startswith("OBJECT")
    ok, insufficient = F.coalesce(ok, F.lit(False)), F.coalesce(insufficient, F.lit(False))
    take = lambda value, canon: F.when(insufficient, canon).when(ok, value)
    return rows.withColumns(
        {
            "contract_ok": ok | insufficient,
            "result": take(p["result"], F.lit("insufficient_sources")),
            "answer": take(F.col("_clean"), F.lit(INSUFFICIENT)),
            "used_passage_ids": take(p["ids"], F.array().cast("array<string>")),
            "needs_human_review": take(p["review"], F.lit(False)),
        }
    ).drop("_p", "_clean")


_TOKEN = re.compile(r'"(?:\\.|[^"\\])*("|\Z)|[{}]', re.S)


def _salvage(text: str) -> str | None:
    body = re.sub(r"```\s*\Z", "", re.sub(r"\A\s*```(?:json)?\s*", "", text, flags=re.I))
    depth, begin = 0, None
    for token in _TOKEN.finditer(body):
        mark = token.group()
        if mark == "{":
            begin, depth = (token.start() if depth == 0 else begin), depth + 1
        elif mark == "}" and depth:
            depth -= 1
            if depth == 0:
                quoted = lambda m: re.sub(r"(?<!\\)[\x00-\x1f]", lambda c: json.dumps(c.group())[1:-1], m.group())
                return re.sub(r'"(?:\\.|[^"\\])*"', quoted, body[begin : token.end()], flags=re.S)
        elif mark[0] == '"' and not token.group(1):
            return None
    return None


@F.pandas_udf(StringType())
def _salvages(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _salvage(t))


def salvage_json(raw: Column, rejected: Column) -> Column:
    """First balanced object of a rejected output with its control characters escaped; others never reach Python."""
    return F.when(rejected, _salvages(F.when(rejected, raw)))


def output_shape(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Shape of an output without its content: what was found and which rule it breaks."""
    direct = F.try_parse_json(raw).isNotNull()
    rows = df.withColumn("_saved", salvage_json(F.col(raw), ~direct))
    embedded = ~direct & F.try_parse_json("_saved").isNotNull()
    rows = rows.withColumns({"candidate": F.when(direct, "raw").when(embedded, "embedded").otherwise("none"), "_json": F.when(direct, F.col(raw)).when(embedded, F.col("_saved"))})
    rows = rows.withColumn("_p", F.struct(*[c.alias(n) for n, c in _parsed(F.col("_json")).items()]))
    p = F.col("_p")
    keys = F.coalesce(F.json_object_keys("_json"), F.array().cast("array<string>"))
    expected = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in FIELDS.split(",")])))
    valid_ids = F.size(F.filter(p["ids"], is_uuid))
    listed = p["ids_kind"].startswith("ARRAY")
    length = F.length(js_trim(p["answer"]))
    issue = first_match(
        (F.col("candidate") == "none", "syntax_invalid"),
        (~p["root"].startswith("OBJECT"), "root_invalid"),
        (F.coalesce(p["result"] == "insufficient_sources", F.lit(False)), "unexpected_acceptance"),
        ((F.size(keys) != 4) | (expected != 4), "fields_invalid"),
        (~F.coalesce(p["result"].isin(*RESULTS), F.lit(False)), "result_invalid"),
        ((p["answer_kind"] != "STRING") | ~F.coalesce(length.between(1, MAX_ANSWER), F.lit(False)), "answer_invalid"),
        (~listed | (F.size(p["ids"]) > MAX_IDS) | (valid_ids != F.size(p["ids"])), "used_passage_ids_invalid"),
        (p["review_kind"] != "BOOLEAN", "needs_human_review_invalid"),
        ((p["result"] == "needs_clarification") != (F.size(p["ids"]) == 0), "citation_cardinality_invalid"),
        default="unexpected_acceptance",
    )
    return rows.withColumns(
        {
            "contract_issue": issue, "expected_fields": expected, "extra_fields": F.size(keys) - expected,
            "answer_length": F.when(p["answer_kind"] == "STRING", F.length(p["answer"])),
            "id_count": F.when(listed, F.size(p["ids"])), "valid_id_count": F.when(listed, valid_ids),
        }
    ).drop("_saved", "_json", "_p")


def numeric_tokens(col: Column) -> Column:
    """Numbers with their unit and number words with theirs, in a comparable spelling."""

    def tokens(text: Column) -> Column:
        spelled = F.regexp_extract_all(text, F.lit(DIGITS), F.lit(0))

        def token(m: Column) -> Column:
            unit = F.regexp_extract(m, DIGITS, 2)
            value = number_text(parse_decimal_comma(F.regexp_extract(m, DIGITS, 1)))
            return F.when(unit != "", F.concat_ws("|", value, unit)).otherwise(value)

        said = F.filter(F.regexp_extract_all(text, F.lit(pattern(NUMBER_WORDS)), F.lit(1)), lambda m: m != "")
        return F.concat(F.transform(spelled, token), F.transform(said, lambda m: F.concat(F.lit("words|"), collapse(m))))

    return let(F.lower(strip_marks(col)), tokens)


def has_unit_number(tokens: Column, unit: Column) -> Column:
    """Whether one of the tokens counts in the unit of a rule (days)."""
    days = F.exists(tokens, lambda t: t.rlike("\\|jours?\\z") | t.rlike("^words\\|.*\\sjours?\\z"))
    return (unit == "days") & days


def clarification_issue(col: Column) -> Column:
    """numeric when a clarification states a number, vague when it only uses generic words, else null."""
    generic = F.array(*[F.lit(w) for w in GENERIC_WORDS])
    return F.when(F.size(numeric_tokens(col)) > 0, "numeric").when(F.size(F.array_except(words(col), generic)) == 0, "vague")


EVIDENCE = ("title", "version_label", "effective_date", "section_title", "article_reference", "source_reference", "content")


def evidence_tokens(passages: DataFrame) -> DataFrame:
    """Add the distinct numeric tokens of each passage and its captions, computed once per passage."""
    given = [F.col(c) for c in EVIDENCE if c in passages.columns]
    return passages.withColumn("evidence", F.array_distinct(numeric_tokens(F.concat_ws("\n", *given))))


def ungrounded_numbers(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Numbers an answer states that none of the passages it cites contains.

    ``sources`` holds (key, passage_id, evidence): the context of each answer.
    """
    claims = answers.withColumn("claims", F.array_distinct(numeric_tokens(F.col("answer"))))
    cited = claims.select(key, "claims", F.explode(F.array_distinct("used_passage_ids")).alias("passage_id")).join(sources.select(key, "passage_id", "evidence"), [key, "passage_id"])
    backed = cited.groupBy(key).agg(F.flatten(F.collect_set(F.array_intersect("claims", "evidence"))).alias("_backed"))
    out = claims.join(backed, key, "left")
    return out.withColumn("ungrounded", F.array_except("claims", F.coalesce("_backed", F.array().cast("array<string>")))).drop("_backed")


def invalid_citations(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Cited ids that are not in the answer's context, one row each."""
    cited = answers.select(key, F.explode(F.array_distinct("used_passage_ids")).alias("passage_id"))
    return cited.join(sources.select(key, "passage_id"), [key, "passage_id"], "left_anti")


def audit_answers(answers: DataFrame, sources: DataFrame, rule_sources: DataFrame, protected: DataFrame, key: str = "answer_id") -> DataFrame:
    """The answer a person may see for every model answer, with log result and error code.

    ``sources``: (key, passage_id, evidence); ``rule_sources`` and ``protected``: (passage_id, result_unit).
    """
    claims = answers.withColumn("_claims", F.array_distinct(numeric_tokens(F.col("answer"))))
    cited = claims.select(key, "_claims", F.explode(F.array_distinct("used_passage_ids")).alias("passage_id"))
    known = cited.join(sources.select(key, "passage_id", "evidence"), [key, "passage_id"], "left")
    units = lambda df, name: df.groupBy("passage_id").agg(F.collect_set("result_unit").alias(name))
    known = known.join(units(protected, "_protected"), "passage_id", "left").join(units(rule_sources, "_ruled"), "passage_id", "left")
    per = known.groupBy(key).agg(
        F.count("*").alias("_ids"), F.count("evidence").alias("_found"),
        F.flatten(F.collect_set(F.array_intersect("_claims", "evidence"))).alias("_backed"),
        F.array_distinct(F.flatten(F.collect_set("_protected"))).alias("_protected"), F.array_distinct(F.flatten(F.collect_set("_ruled"))).alias("_ruled"),
    )
    rows = claims.join(per, key, "left")
    empty = F.array().cast("array<string>")
    backed = F.coalesce("_backed", empty)
    counted = lambda name: F.exists(F.coalesce(F.col(name), empty), lambda u: has_unit_number(F.col("_claims"), u))
    guarded = (F.size(F.coalesce(F.col("_protected"), empty)) > 0) & ((F.size("_claims") == 0) | counted("_protected"))
    issue = clarification_issue(F.col("answer"))
    clarifies = F.col("result") == "needs_clarification"
    missing = F.coalesce(F.col("_ids"), F.lit(0)) == 0
    code = first_match(
        (F.col("result") == "insufficient_sources", "insufficient"),
        (clarifies & (issue == "numeric"), "needs_clarification_numeric_rejected"),
        (clarifies & (issue == "vague"), "needs_clarification_vague_rejected"),
        (clarifies, "needs_clarification"),
        (missing | (F.col("_found") < F.col("_ids")), "invalid_citation"),
        (guarded, "deterministic_rule_required"),
        (F.size(F.array_except("_claims", backed)) > 0, "ungrounded_numeric_answer"),
        (counted("_ruled"), "deterministic_rule_required"),
        (F.col("result") == "conflicting_sources", "conflicting_sources"),
        default="ok",
    )
    rows = rows.withColumn("_code", code)
    c = F.col("_code")
    withheld = c.isin("invalid_citation", "deterministic_rule_required", "ungrounded_numeric_answer") | c.endswith("_rejected") | (c == "insufficient")
    message = (
        F.when(c.isin("insufficient", "invalid_citation"), INSUFFICIENT).when(c == "deterministic_rule_required", RULE_REQUIRED)
        .when(c == "ungrounded_numeric_answer", UNGROUNDED).when(c.endswith("_rejected"), IMPRECISE).otherwise(F.col("answer"))
    )
    review = (
        F.when(c.isin("insufficient", "invalid_citation", "needs_clarification"), F.lit(False))
        .when(withheld | (c == "conflicting_sources"), F.lit(True)).otherwise(F.col("needs_human_review"))
    )
    return rows.withColumns(
        {
            "client_result": F.when(withheld, "insufficient_sources").otherwise(F.col("result")),
            "client_answer": message,
            "client_review": review,
            "log_result": F.when(c == "ok", "supported").otherwise("insufficient_sources"),
            "error_code": F.when(~c.isin("ok", "insufficient"), c),
            "citation_count": F.when(c.isin("ok", "conflicting_sources"), F.col("_ids")).otherwise(F.lit(0)),
        }
    ).drop("_claims", "_ids", "_found", "_backed", "_protected", "_ruled", "_code")


def shown_citations(audited: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """The passages under every answer that is shown with citations, in the order it named them, each with the excerpt it rests on.

    ``audited``: rows of :func:`audit_answers`; ``sources``: (key, passage_id, content and what a citation shows of its document).
    """
    shown = audited.where("citation_count > 0").select(key, "answer", "used_passage_ids")
    return citations(shown, sources, key)


def audit_rule_answers(answers: DataFrame, sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Rule answers may be shown only when every passage they rest on is at hand."""
    absent = invalid_citations(answers, sources, key).groupBy(key).agg(F.count("*").alias("_absent"))
    rows = answers.join(absent, key, "left")
    supported = F.col("result") == "supported"
    broken = supported & ((F.size("used_passage_ids") == 0) | (F.coalesce("_absent", F.lit(0)) > 0))
    return rows.withColumns(
        {
            "client_result": F.when(broken, "insufficient_sources").otherwise(F.col("result")),
            "client_answer": F.when(broken, BLOCKED).otherwise(F.col("answer")),
            "client_review": F.when(broken | (F.col("result") == "insufficient_sources"), F.lit(True)).otherwise(F.col("needs_human_review")),
            "log_result": F.when(supported & ~broken, "supported").otherwise("insufficient_sources"),
            "audit_code": F.when(broken, "invalid_deterministic_citation").otherwise(F.col("error_code")),
        }
    ).drop("_absent")


def safe_error_code(col: Column) -> Column:
    code = F.left(F.regexp_replace(F.lower(col), "[^a-z0-9_]", "_"), F.lit(100))
    return F.when(F.coalesce(code, F.lit("")) == "", "unexpected_error").otherwise(code)


def public_error(code: Column, http_status: Column) -> Column:
    """Code shown outside: internal failures fold into three."""
    return (
        F.when(code.isin(*PASSED_ERRORS), code)
        .when(code.startswith("embedding_") & (http_status == 502), "embedding_unavailable")
        .when(code.startswith("generation_") & (http_status == 502), "generation_unavailable")
        .otherwise("server_error")
    )
