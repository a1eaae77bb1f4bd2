"""Question analytics over conversations and over questions derived from order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.functions.text import fold
from agoradesk.operators import questions as qs
from agoradesk.session import spread
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"

ASKED_SQL = """asked as (select *, case v when 0 then 'J’ai ' || age || ' ans, combien de vacances ?'
 when 1 then 'Combien de congés payés avec ' || s || ' ans de service ?'
 when 2 then 'J''ai ' || age || ' ans et ' || s || ' années de service, combien de vacances ?'
 when 3 then case l_partkey % 4 when 0 then 'Combien de jours pour mon mariage ?' when 1 then 'Combien de jours pour le décès de mon père ?'
   when 2 then 'Combien de jours pour le décès de ma belle-mère ?' else 'Mariage de mon frère : combien de jours ?' end
 when 4 then 'J''ai ' || age || ',5 ans, combien de jours de vacances ?' when 5 then 'Je vais déménager, combien de jours de congé ?'
 when 6 then 'À l''âge de 30 ans, j''ai ' || age || ' ans, combien de vacances ?'
 when 7 then case l_partkey % 4 when 0 then 'Combien de jours de congé ?' when 1 then 'Congé pour un examen professionnel'
   when 2 then 'Quel congé pour un deuil ?' else 'Quels types de congés existent ?' end
 else 'Décès de mon père et mon mariage : quel congé ?' end question
 from (select l_orderkey, l_linenumber, l_partkey, l_suppkey institution_id, (l_orderkey + l_linenumber) % 9 v, 10 + cast(l_quantity as bigint) age,
   cast(round(l_discount * 100) as bigint) * 4 s from lineitem))"""

# Every institution has its own templates: another least age, most years of service, and list of reasons. "avec n ans de service" (v = 1) is
# found by two patterns, and each mention out of range is an error of its own.
FACTS_SQL = ASKED_SQL + """,
bounds as (select *, 14 + 4 * (institution_id % 2) least_age, case when institution_id % 5 = 4 then 30 else 80 end most_service, institution_id % 4 <> 1 may_move from asked),
facts as (select *, case when v in (0, 1, 2, 4, 6) then 'annual_leave_days' when v in (3, 5, 8) then 'fixed_duration_exceptional_leave_by_event' end template_key,
 case when v in (0, 2) and age >= least_age then age when v = 6 and (age = 30 or age < least_age) then 30 end f_age,
 case when v in (1, 2) and s <= most_service then s end f_service,
 case when v = 5 and may_move then 'moving' when v = 3 and l_partkey % 4 = 0 then 'marriage' when v = 3 and l_partkey % 4 = 1 then 'death_first_degree' when v = 3 and l_partkey % 4 = 2 then 'death_second_degree' end f_reason,
 case when (v in (0, 2, 6) and age < least_age) or v = 4 or (v in (1, 2) and s > most_service) then 'invalid' when v = 8 or (v = 6 and age <> 30) then 'conflicting' else 'ok' end facts_status,
 concat_ws(',', case when (v in (0, 2, 6) and age < least_age) or v = 4 then 'age_years_out_of_range' when v = 8 then 'conflicting_leave_reason' when v = 6 and age <> 30 then 'conflicting_age_years' end,
  case when v = 1 and s > most_service then 'service_years_out_of_range,service_years_out_of_range' when v = 2 and s > most_service then 'service_years_out_of_range' end) facts_errors from bounds)"""


def asked(spark, sf):
    line = spread(read_table(spark, sf, "lineitem"))
    rows = line.select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("institution_id"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 9).alias("v"),
        (F.col("l_partkey") % 4).alias("p"), (10 + F.col("l_quantity").cast("long")).cast("string").alias("age"),
        (F.round(F.col("l_discount") * 100).cast("long") * 4).cast("string").alias("s"))
    v, p, age, s = (F.col(c) for c in ("v", "p", "age", "s"))
    text = (
        F.when(v == 0, F.concat(F.lit("J’ai "), age, F.lit(" ans, combien de vacances ?")))
        .when(v == 1, F.concat(F.lit("Combien de congés payés avec "), s, F.lit(" ans de service ?")))
        .when(v == 2, F.concat(F.lit("J'ai "), age, F.lit(" ans et "), s, F.lit(" années de service, combien de vacances ?")))
        .when(v == 3, F.when(p == 0, "Combien de jours pour mon mariage ?").when(p == 1, "Combien de jours pour le décès de mon père ?")
              .when(p == 2, "Combien de jours pour le décès de ma belle-mère ?").otherwise("Mariage de mon frère : combien de jours ?"))
        .when(v == 4, F.concat(F.lit("J'ai "), age, F.lit(",5 ans, combien de jours de vacances ?")))
        .when(v == 5, "Je vais déménager, combien de jours de congé ?")
        .when(v == 6, F.concat(F.lit("À l'âge de 30 ans, j'ai "), age, F.lit(" ans, combien de vacances ?")))
        .when(v == 7, F.when(p == 0, "Combien de jours de congé ?").when(p == 1, "Congé pour un examen professionnel")
              .when(p == 2, "Quel congé pour un deuil ?").otherwise("Quels types de congés existent ?"))
        .otherwise("Décès de mon père et mon mariage : quel congé ?")
    )
    return rows.select("l_orderkey", "l_linenumber", "institution_id", text.alias("question"))


@register("normalized_questions", f"select conv_id, turn, case when length(t) between 3 and 1000 then sha256(t) end question_sha256 from (select conv_id, turn, {CLEAN} t from conversations)")
def normalized_questions(spark, sf):
    c = read_table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.sha2(qs.normalize_question(F.col("text")), 256).alias("question_sha256"))


@register("effective_questions", f"""with t as (select conv_id, turn, {CLEAN} t from conversations where role = 'user'), k as (select *, row_number() over w n,
  sum(length(t) + 31) over w - 31 + 20 size, string_agg(t, chr(10) || 'Complément de l’utilisateur : ') over w told from t where length(t) between 3 and 1000 window w as (partition by conv_id order by turn))
 select conv_id, turn, n turn_number, case when n = 1 then sha256(t) when size <= 5100 then sha256('Question initiale : ' || told) end effective_sha256 from k""")
def effective_questions(spark, sf):
    c = read_table(spark, sf, "conversations").where("role = 'user'")
    out = qs.effective_questions(c, "conv_id", "turn", "text")
    return out.select("conv_id", "turn", "turn_number", F.sha2("effective_question", 256).alias("effective_sha256"))


@register("whole_questions", f"""with t as (select conv_id, turn, {CLEAN} t from conversations where role = 'user'), k as (select *, row_number() over w n, count(nullif(t, '')) over w said,
  string_agg(nullif(t, ''), chr(10) || 'Complément de l’utilisateur : ') over w told from t window w as (partition by conv_id order by turn rows unbounded preceding)),
 e as (select *, case when said > 1 then 'Question initiale : ' || told else told end effective from k)
 select conv_id, turn, n turn_number, sha256(t) question_sha256, sha256(effective) effective_sha256,
  case when coalesce(length(t), 0) < 3 then 'too_short' when length(t) > 1000 then 'too_long' else 'ok' end question_status,
  case when said > 1 and length(effective) > 5100 then 'too_long' else 'ok' end effective_status from e""")
def whole_questions(spark, sf):
    out = qs.whole_questions(read_table(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", "turn_number", F.sha2("question", 256).alias("question_sha256"), F.sha2("effective_question", 256).alias("effective_sha256"),
                      "question_status", "effective_status")


@register("question_requests", f"""with b as (select conv_id, turn, role, {CLEAN} t from conversations)
 select conv_id, turn, case when (conv_id + turn) % 7 = 0 then 'invalid_request' when not length(t) between 3 and 1000 then 'invalid_question' when turn > 0 and not length(t) between 3 and 4000 then 'invalid_pending_question'
  when turn > 0 and 2 * length(t) + 51 > 5100 then 'question_too_long' else 'ok' end request_status from b""")
def question_requests(spark, sf):
    c = read_table(spark, sf, "conversations")
    odd = (F.col("conv_id") + F.col("turn")) % 7 == 0
    body = F.to_json(F.struct(F.when(odd, 1).alias("extra"), F.when(F.col("turn") > 0, F.col("text")).alias("pending_question"), F.col("text").alias("question")))
    return qs.validate_questions(c.select("conv_id", "turn", body.alias("body"))).select("conv_id", "turn", "request_status")


@register("question_intents", "with " + FACTS_SQL + " select l_orderkey, l_linenumber, template_key from facts")
def question_intents(spark, sf):
    return asked(spark, sf).select("l_orderkey", "l_linenumber", qs.detect_intent(fold(F.col("question"))).alias("template_key"))


@register("question_routes", "with " + FACTS_SQL + f""" select l_orderkey, l_linenumber, case when v = 7 and l_partkey % 4 = 0 then '{qs.TYPE_CLARIFICATION}'
 when v = 7 and l_partkey % 4 = 2 then '{qs.RELATION_CLARIFICATION}' end clarification from facts""")
def question_routes(spark, sf):
    return asked(spark, sf).select("l_orderkey", "l_linenumber", qs.route_question(fold(F.col("question"))).alias("clarification"))


@register("question_facts", "with " + FACTS_SQL + """ select l_orderkey, l_linenumber, cast(f_age as double) age_years, cast(f_service as double) service_years, f_reason leave_reason, facts_status, facts_errors
 from facts where template_key is not null""")
def question_facts(spark, sf):
    from agoradesk.plans.entitlements import templates

    rows = qs.read_questions(asked(spark, sf))
    own = templates(spark, sf).withColumn("_traits", qs.template_traits(F.col("template")))
    out = qs.extract_facts(rows.join(own, ["institution_id", "template_key"]))
    f = F.col("facts")
    return out.select("l_orderkey", "l_linenumber", f["age_years"]["number_value"].alias("age_years"), f["service_years"]["number_value"].alias("service_years"),
                      f["leave_reason"]["category_value"].alias("leave_reason"), "facts_status", F.array_join("facts_errors", ",").alias("facts_errors"))


@register("conversation_intents", r"""select role, count(*) turns, count(*) filter (where regexp_matches(f, '\bvacances?\b|\bconges?\s+(?:annuels?|payes?)\b')) annual,
 count(*) filter (where regexp_matches(f, '\bconges?\b')) leave_words from (select role, lower(strip_accents(text)) f from conversations) group by 1""")
def conversation_intents(spark, sf):
    f = fold(F.col("text"))
    c = read_table(spark, sf, "conversations").select("role", qs.targets_annual(f).alias("a"), qs.says(f, r"\bconges?\b").alias("c"))
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.count_if("a").alias("annual"), F.count_if("c").alias("leave_words"))


@register("rule_signals", r"""with t as (select conv_id, turn, lower(strip_accents(text)) f from conversations), p as (select t.*, coalesce(lead(f) over (partition by conv_id order by turn), '') a from t)
 select conv_id, turn, regexp_matches(f, '\b(?:combien|calcul|seuil|minimum|maximum|a partir de|plus de|moins de|age|anciennete|ans? de service|jours?|semaines?|mois|montant|pourcentage|salaire|vacances?)\b|[0-9]')
  or regexp_matches(a, '[0-9]\s*(?:(?:jours?|ans?|semaines?|mois|chf|francs?)\b|%\b)')
  or regexp_matches(a, '\b(?:un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingt|vingts|trente|quarante|cinquante|soixante|cent)\s+(?:jours?|ans?|semaines?|mois)\b') needs_rules from p""")
def rule_signals(spark, sf):
    from agoradesk.operators.ordered import with_neighbours

    c = read_table(spark, sf, "conversations")
    paired = with_neighbours(c, ["conv_id"], ["turn"], F.floor(F.col("turn") / 256), lead={"reply": F.col("text")})
    return paired.select("conv_id", "turn", qs.needs_rules(F.col("text"), F.col("reply")).alias("needs_rules"))


@register("continuations", "select conv_id, turn, case when turn % 2 = 0 then sha256(text) end pending_sha256 from conversations")
def continuations(spark, sf):
    c = read_table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("effective_question"),
                                                      F.when(F.col("turn") % 2 == 0, "needs_clarification").otherwise("supported").alias("result"))
    return qs.with_continuation(c).select("conv_id", "turn", F.sha2("pending_question", 256).alias("pending_sha256"))
