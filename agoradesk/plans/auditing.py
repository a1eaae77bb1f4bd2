"""Audit of answers built from the conversations, citing the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.functions.columns import uuid_from
from agoradesk.operators import answers as an
from agoradesk.operators import retrieval as rt
from agoradesk.plans import roles
from agoradesk.session import spread
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


def uuid_sql(e: str) -> str:
    h = f"sha256('p' || chr(31) || {e})"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def pid(col):
    return uuid_from(F.lit("p"), col)


# Answers: k = conv_id * 100 + turn picks the shape, the claim and the cited documents.
ANSWERS_SQL = """ans as (select conv_id * 100 + turn k, text, ['supported', 'supported', 'needs_clarification', 'conflicting_sources', 'insufficient_sources', 'other'][1 + (conv_id + turn) % 6] as result,
  (conv_id * 7) % n d1, (conv_id * 7 + 1 + turn % 2 * 5 * n) % (7 * n) d2
  from conversations, (select max(doc_id) + 1 n from documents) where role <> 'system')"""
TEXT_SQL = """case when result = 'needs_clarification' then case k % 3 when 0 then 'Peux-tu préciser ta situation ?' when 1 then 'As-tu plus de 20 ans ?' else 'Quel est ton métier ?' end
   when k % 5 = 0 then 'Réponse sans nombre.' when k % 5 = 1 then 'Tu as droit à ' || (d1 % 5) || ' jours.' when k % 5 = 2 then 'Cela dure trois semaines.' when k % 5 = 3 then 'Il faut ' || (d1 % 4) || ',0 heures (passage_id: '
    || {u} || ') .' else 'De 10-20 % selon le cas' end"""


def cited(result, d1, d2):
    none = F.array().cast("array<string>")
    return F.when(result.isin("needs_clarification", "insufficient_sources"), none).otherwise(F.array(pid(d1), pid(d2)))


def answers(spark, sf):
    c = read_table(spark, sf, "conversations").where("role <> 'system'")
    k = F.col("conv_id") * 100 + F.col("turn")
    n = roles.span(spark, sf, "documents", "doc_id")
    shapes = F.array(*[F.lit(x) for x in ("supported", "supported", "needs_clarification", "conflicting_sources", "insufficient_sources", "other")])
    rows = c.select(
        k.alias("k"), F.element_at(shapes, (1 + (F.col("conv_id") + F.col("turn")) % 6).cast("int")).alias("result"),
        (F.col("conv_id") * 7 % n).alias("d1"), ((F.col("conv_id") * 7 + 1 + F.col("turn") % 2 * 5 * n) % (7 * n)).alias("d2"), "text")
    k, r, d1 = F.col("k"), F.col("result"), F.col("d1")
    said = (
        F.when(r == "needs_clarification", F.when(k % 3 == 0, "Peux-tu préciser ta situation ?").when(k % 3 == 1, "As-tu plus de 20 ans ?").otherwise("Quel est ton métier ?"))
        .when(k % 5 == 0, "Réponse sans nombre.")
        .when(k % 5 == 1, F.concat(F.lit("Tu as droit à "), (d1 % 5).cast("string"), F.lit(" jours.")))
        .when(k % 5 == 2, "Cela dure trois semaines.")
        .when(k % 5 == 3, F.concat(F.lit("Il faut "), (d1 % 4).cast("string"), F.lit(",0 heures (passage_id: "), pid(d1), F.lit(") .")))
        .otherwise("De 10-20 % selon le cas")
    )
    return rows.withColumns({"said": said, "ids": cited(r, d1, F.col("d2"))})


def raw_outputs(spark, sf):
    a = answers(spark, sf)
    k = F.col("k")
    full = F.to_json(F.struct(F.col("result"), F.col("said").alias("answer"), F.col("ids").alias("used_passage_ids"), (k % 2 == 0).alias("needs_human_review")))
    short = F.to_json(F.struct(F.col("result"), F.col("said").alias("answer")))
    fenced = F.concat(F.lit("```json\n"), F.replace(full, F.lit("Tu as"), F.lit("Tu\tas")), F.lit("\n```"))
    raw = F.when(k % 11 == 0, short).when(k % 11 == 1, fenced).when(k % 11 == 2, F.lit('{"result": ')).when(k % 11 == 3, F.lit("[1]")).otherwise(full)
    return a.withColumn("raw", raw)


SHAPE_SQL = "with " + ANSWERS_SQL + ", said as (select *, " + TEXT_SQL.format(u=uuid_sql("d1")) + " said from ans)"
CLEAN_SQL = r"trim(regexp_replace(regexp_replace(said, '\s*\(passage_id: [0-9a-f-]{36}\)', '', 'g'), '\s+([,.;:!?])', '\1', 'g'))"


@register("answer_contracts", SHAPE_SQL + f""" select k, ok contract_ok, case when ok then result end as result, case when ok then case when result = 'insufficient_sources' then '{an.INSUFFICIENT}' else {CLEAN_SQL} end end answer,
 case when ok then case when result = 'insufficient_sources' then false else k % 2 = 0 end end needs_human_review
 from (select *, case when result = 'insufficient_sources' then k % 11 not in (1, 2, 3) else k % 11 > 3 and result <> 'other' end ok from said)""")
def answer_contracts(spark, sf):
    return an.parse_answers(raw_outputs(spark, sf).drop("result")).select("k", "contract_ok", "result", "answer", "needs_human_review")


@register("salvaged_outputs", SHAPE_SQL + " select k, k % 11 = 1 salvaged from said where k % 11 in (1, 2, 3)")
def salvaged_outputs(spark, sf):
    rows = an.parse_answers(raw_outputs(spark, sf).drop("result"))
    rejected = rows.where("not contract_ok and k % 11 in (1, 2, 3)")
    saved = rejected.select("k", an.salvage_json(F.col("raw"), ~F.col("contract_ok")).alias("json"))
    return saved.select("k", F.try_parse_json("json").isNotNull().alias("salvaged"))


FULL_SQL = """'{"result":"' || result || '","answer":"' || said || '","used_passage_ids":[' || case when result in ('needs_clarification', 'insufficient_sources') then '' else
  '"' || """ + uuid_sql("d1") + """ || '","' || """ + uuid_sql("d2") + """ || '"' end || '],"needs_human_review":' || (k % 2 = 0) || '}'"""


@register("salvaged_texts", SHAPE_SQL + f""", ok as (select *, case when result = 'insufficient_sources' then k % 11 not in (1, 2, 3) else k % 11 > 3 and result <> 'other' end ok from said)
 select k, case when ok or k % 11 in (2, 3) then null when k % 11 = 0 then '{{"result":"' || result || '","answer":"' || said || '"}}' when k % 11 = 1 then replace({FULL_SQL}, 'Tu as', 'Tu\\tas') else {FULL_SQL} end json from ok""")
def salvaged_texts(spark, sf):
    """What is left of every output that breaks the contract, as text; null for accepted ones and those without an object."""
    rows = an.parse_answers(raw_outputs(spark, sf).drop("result"))
    return rows.select("k", an.salvage_json(F.col("raw"), ~F.col("contract_ok")).alias("json"))


@register("output_shapes", SHAPE_SQL + """ select k, case k % 11 when 1 then 'embedded' when 2 then 'none' else 'raw' end candidate, case when k % 11 = 2 then 'syntax_invalid' when k % 11 = 3 then 'root_invalid'
  when result = 'insufficient_sources' then 'unexpected_acceptance' when k % 11 = 0 then 'fields_invalid' when result = 'other' then 'result_invalid' else 'unexpected_acceptance' end contract_issue,
  cast(case when k % 11 in (2, 3) then 0 when k % 11 = 0 then 2 else 4 end as bigint) expected_fields,
  case when k % 11 not in (0, 2, 3) then cast(case when result in ('needs_clarification', 'insufficient_sources') then 0 else 2 end as bigint) end id_count from said""")
def output_shapes(spark, sf):
    out = an.output_shape(raw_outputs(spark, sf).drop("result"))
    return out.select("k", "candidate", "contract_issue", F.col("expected_fields").cast("long").alias("expected_fields"), F.col("id_count").cast("long").alias("id_count"))


TOKENS = r"""list_concat(list_transform(regexp_extract_all({t}, '[-+]?\d+(?:[.,]\d+)?\s*(?:%|jours?|ans?|annees?|semaines?|mois|heures?|chf|francs?)?'),
  lambda m: regexp_replace((replace(regexp_extract(m, '^[-+]?[\d.,]+'), ',', '.')::double + 0)::varchar, '\.0$', '') || case when regexp_matches(m, '[%a-z]') then '|' || trim(regexp_extract(m, '[%a-z]+$')) else '' end),
 list_transform(regexp_extract_all({t}, '\b(?:un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingt|vingts|trente|quarante|cinquante|soixante|cent)\s+(?:jours?|ans?|semaines?|mois|heures?|francs?)\b'),
  lambda m: 'words|' || regexp_replace(m, '\s+', ' ', 'g')))"""


@register("numeric_tokens", SHAPE_SQL + ", t as (select k, lower(strip_accents(said)) t from said) select k, array_to_string(" + TOKENS.format(t="t") + ", ';') tokens from t")
def numeric_tokens(spark, sf):
    return answers(spark, sf).select("k", F.array_join(an.numeric_tokens(F.col("said")), ";").alias("tokens"))


@register("document_number_tokens", r"""select doc_id, cast(len(regexp_extract_all(lower(strip_accents(text)), '[-+]?\d+(?:[.,]\d+)?')) as bigint) digit_tokens from documents""")
def document_number_tokens(spark, sf):
    d = read_table(spark, sf, "documents")
    t = an.numeric_tokens(F.col("text"))
    return d.select("doc_id", F.size(F.filter(t, lambda x: ~x.startswith("words|"))).cast("long").alias("digit_tokens"))


@register("clarification_issues", SHAPE_SQL + " select k, case k % 3 when 0 then 'vague' when 1 then 'numeric' end issue from said where result = 'needs_clarification'")
def clarification_issues(spark, sf):
    rows = answers(spark, sf).where("result = 'needs_clarification'")
    return rows.select("k", an.clarification_issue(F.col("said")).alias("issue"))


CONTEXT_SQL = ", docs as (select doc_id, text || ' ' || (doc_id % 5) || ' jours, ' || (doc_id % 3) || ' heures.' content from documents), ev as (select doc_id, " + TOKENS.format(
    t="lower(strip_accents(content))") + " ev from docs), cl as (select k, result, d1, d2, said, list_distinct(" + TOKENS.format(t="lower(strip_accents(said))") + """) claims from (select k, result, d1, d2, """ + CLEAN_SQL + """ said from said where result <> 'other')),
 ids as (select k, result, claims, said, unnest(case when result in ('needs_clarification', 'insufficient_sources') then [] else list_distinct([d1, d2]) end) d from cl),
 per as (select k, count(*) n, count(doc_id) f, list_distinct(flatten(list(ev))) ev, bool_or(d % 9 = 0) prot, bool_or(d % 4 = 1) ruled from ids left join ev on doc_id = d group by 1),
 j as (select cl.*, n, f, prot, ruled, list_filter(claims, lambda c: not list_contains(coalesce(ev, []), c)) bad, len(list_filter(claims, lambda c: regexp_matches(c, '[|]jours?$'))) > 0 indays from cl left join per using (k)),
 code as (select *, case when result = 'insufficient_sources' then 'insufficient' when result = 'needs_clarification' then case k % 3 when 0 then 'needs_clarification_vague_rejected' when 1 then 'needs_clarification_numeric_rejected' else 'needs_clarification' end
   when f < n then 'invalid_citation' when prot and (len(claims) = 0 or indays) then 'deterministic_rule_required' when len(bad) > 0 then 'ungrounded_numeric_answer' when ruled and indays then 'deterministic_rule_required'
   when result = 'conflicting_sources' then 'conflicting_sources' else 'ok' end c from j)"""


def audited_text():
    n = F.col("doc_id")
    return F.concat(F.col("text"), F.lit(" "), (n % 5).cast("string"), F.lit(" jours, "), (n % 3).cast("string"), F.lit(" heures."))


def audit_tables(spark, sf):
    a = answers(spark, sf).where("result <> 'other'").select(
        F.col("k").alias("answer_id"), "result", an.sanitize_answer(F.col("said")).alias("answer"), F.col("ids").alias("used_passage_ids"),
        (F.col("k") % 2 == 0).alias("needs_human_review"))
    d = spread(read_table(spark, sf, "documents"))
    n = F.col("doc_id")
    passages = an.evidence_tokens(d.select(pid(n).alias("passage_id"), n.alias("doc_id"), audited_text().alias("content")))
    context = a.select("answer_id", F.explode("used_passage_ids").alias("passage_id")).distinct().join(passages.select("passage_id", "evidence"), "passage_id")
    protected = passages.where("doc_id % 9 = 0").select("passage_id", F.lit("days").alias("result_unit"))
    ruled = passages.where("doc_id % 4 = 1").select("passage_id", F.lit("days").alias("result_unit"))
    return a, context, ruled, protected


@register("answer_audit", SHAPE_SQL + CONTEXT_SQL + f""" select k answer_id, case when c in ('ok', 'conflicting_sources', 'needs_clarification') then result else 'insufficient_sources' end client_result,
 case when c in ('insufficient', 'invalid_citation') then '{an.INSUFFICIENT}' when c = 'deterministic_rule_required' then '{an.RULE_REQUIRED}' when c = 'ungrounded_numeric_answer' then '{an.UNGROUNDED}' when c like '%rejected' then '{an.IMPRECISE}' else said end client_answer,
 case when c in ('insufficient', 'invalid_citation', 'needs_clarification') then false when c = 'ok' then k % 2 = 0 else true end client_review, case when c = 'ok' then 'supported' else 'insufficient_sources' end log_result,
 case when c not in ('ok', 'insufficient') then c end error_code, case when c in ('ok', 'conflicting_sources') then n else 0 end citation_count from code""")
def answer_audit(spark, sf):
    out = an.audit_answers(*audit_tables(spark, sf))
    return out.select("answer_id", "client_result", "client_answer", "client_review", "log_result", "error_code", "citation_count")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in rt.EXCERPT_STOP_WORDS) + "]"
CITED_SQL = r""", shown as (select k, said focus, unnest(case when d1 = d2 then [{'p': 0, 'd': d1}] else [{'p': 0, 'd': d1}, {'p': 1, 'd': d2}] end) c from code where c in ('ok', 'conflicting_sources')),
 plain as (select k, c.p as position, c.d as doc_id, trim(regexp_replace(content, '\s+', ' ', 'g')) n, regexp_extract_all(lower(strip_accents(focus)), '\p{L}+|\d+(?:[.,]\d+)?%?') raw from shown join docs on doc_id = c.d),
 termed as (select *, lower(strip_accents(n)) h, [raw[i] for i in range(1, len(raw) + 1) if list_position(raw, raw[i]) = i and (regexp_matches(raw[i], '\d') or (len(raw[i]) >= 4 and not list_contains({stop}, raw[i])))] terms from plain),
 begun as (select *, list_concat([0], flatten([[greatest(0, coalesce(list_sum([len(y) for y in string_split(h, t)[1:j]]), 0)::bigint + (j - 1) * len(t) - 120) for j in range(1, len(string_split(h, t)))] for t in terms])) starts from termed),
 scored as (select *, [coalesce(list_sum([case when contains(substr(h, s + 1, 400), t) then case when regexp_matches(t, '\d') then 4 else 1 end else 0 end for t in terms]), 0)::bigint for s in starts] scores from begun),
 best as (select *, starts[list_position(scores, list_max(scores))] b from scored),
 moved as (select *, case when b > 0 and strpos(substr(n, b + 1), ' ') between 1 and 31 then b + strpos(substr(n, b + 1), ' ') else b end a from best),
 ended as (select *, least(len(n), a + 400) e from moved),
 closed as (select *, case when e < len(n) and strpos(reverse(substr(n, 1, e + 1)), ' ') > 0 and e + 1 - strpos(reverse(substr(n, 1, e + 1)), ' ') > a + 370 then e + 1 - strpos(reverse(substr(n, 1, e + 1)), ' ') else e end z from ended)
 select k answer_id, position, doc_id, case when len(n) <= 400 then n else case when a > 0 then '…' else '' end || trim(substr(n, a + 1, z - a)) || case when z < len(n) then '…' else '' end end excerpt from closed"""
CITED_SQL = CITED_SQL.replace("{stop}", STOP_SQL)


@register("shown_citations", SHAPE_SQL + CONTEXT_SQL + CITED_SQL)
def shown_citations(spark, sf):
    """Every citation under the audited answers, with its whole excerpt."""
    a, context, ruled, protected = audit_tables(spark, sf)
    d = read_table(spark, sf, "documents")
    texts = d.select(pid(F.col("doc_id")).alias("passage_id"), "doc_id", audited_text().alias("content"))
    out = an.shown_citations(an.audit_answers(a, context, ruled, protected), context.select("answer_id", "passage_id").join(texts, "passage_id"))
    return out.select("answer_id", F.col("position").cast("long").alias("position"), "doc_id", "excerpt")


@register("ungrounded_numbers", SHAPE_SQL + CONTEXT_SQL + " select k answer_id, array_to_string(list_sort(bad), ';') ungrounded from j")
def ungrounded_numbers(spark, sf):
    a, context, _, _ = audit_tables(spark, sf)
    return an.ungrounded_numbers(a, context).select("answer_id", F.array_join(F.array_sort("ungrounded"), ";").alias("ungrounded"))


@register("invalid_citations", SHAPE_SQL + CONTEXT_SQL + " select k answer_id, count(*) invalid from ids left join ev on doc_id = d where doc_id is null group by 1")
def invalid_citations(spark, sf):
    a, context, _, _ = audit_tables(spark, sf)
    return an.invalid_citations(a, context).groupBy("answer_id").agg(F.count("*").alias("invalid"))


@register("rule_answer_audit", SHAPE_SQL + CONTEXT_SQL + """ select k answer_id, case when result = 'supported' and f < n then 'insufficient_sources' else result end client_result,
 case when result = 'supported' and f < n then 'invalid_deterministic_citation' end audit_code, case when result = 'supported' and f = n then 'supported' else 'insufficient_sources' end log_result from j""")
def rule_answer_audit(spark, sf):
    a, context, _, _ = audit_tables(spark, sf)
    out = an.audit_rule_answers(a.withColumn("error_code", F.lit(None).cast("string")), context)
    return out.select("answer_id", "client_result", "audit_code", "log_result")


@register("public_errors", r"""select event_id, case when length(c) = 0 then 'unexpected_error' else c end code, case when c in ('unauthorized', 'rate_limited') then c when s = 502 and c like 'embedding\_%' escape '\' then 'embedding_unavailable'
  when s = 502 and c like 'generation\_%' escape '\' then 'generation_unavailable' else 'server_error' end public_code from (select event_id, regexp_replace(lower(x), '[^a-z0-9_]', '_', 'g') c, s from (select event_id,
  case event_id % 6 when 0 then 'rate_limited' when 1 then 'Embedding-' || event_type when 2 then 'generation_' || event_type when 3 then '' when 4 then 'unauthorized' else 'É ' || event_type end x, case when user_id % 2 = 0 then 502 else 500 end s from events))""")
def public_errors(spark, sf):
    e = read_table(spark, sf, "events")
    m = F.col("event_id") % 6
    raw = (
        F.when(m == 0, "rate_limited").when(m == 1, F.concat(F.lit("Embedding-"), "event_type")).when(m == 2, F.concat(F.lit("generation_"), "event_type"))
        .when(m == 3, "").when(m == 4, "unauthorized").otherwise(F.concat(F.lit("É "), "event_type"))
    )
    rows = e.select("event_id", an.safe_error_code(raw).alias("code"), F.when(F.col("user_id") % 2 == 0, 502).otherwise(500).alias("s"))
    return rows.select("event_id", "code", an.public_error(F.col("code"), F.col("s")).alias("public_code"))
