"""Questions as a table: normal form, consolidation, intent, routing and typed facts."""

from __future__ import annotations

import functools
import itertools
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match, let
from agoradesk.functions.text import collapse, fold, nfkc, with_folded
from agoradesk.operators.ordered import with_running

# Lengths, wording, patterns. Patterns are matched against folded
# text and use an ASCII word boundary, written \b here.
MIN_QUESTION, MAX_QUESTION, MAX_PENDING, MAX_EFFECTIVE = 3, 1_000, 4_000, 5_100
FIRST_TURN = "Question initiale : "
NEXT_TURN = "Complément de l’utilisateur : "
TYPE_CLARIFICATION = (
    "De quel type de congé parles-tu : vacances annuelles, maladie, maternité ou paternité, décès, proche malade, ou autre situation ?"
)
RELATION_CLARIFICATION = "Quel est ton lien avec la personne décédée ?"
ANNUAL_LEAVE, EXCEPTIONAL_LEAVE = "annual_leave_days", "fixed_duration_exceptional_leave_by_event"
ANNUAL = (r"\bvacances?\b", r"\bconges?\s+(?:annuels?|payes?)\b", r"\bdroit\s+annuel\s+aux?\s+conges?\b")
EXCEPTIONAL = r"\bconges?\s+(?:exceptionnels?|extraordinaires?)\b"
MARRIAGE = r"\b(?:mariage|partenariat\s+enregistre|marie|marier|marions)\b"
OWN_MARRIAGE = (
    r"\b(?:je\s+me\s+(?:marie|marierai|marierais)|je\s+vais\s+me\s+marier|je\s+me\s+suis\s+mariee?|nous\s+nous\s+(?:marions|marierons|marierions)"
    r"|nous\s+nous\s+sommes\s+maries?|mon\s+mariage|notre\s+mariage|mon\s+partenariat\s+enregistre|notre\s+partenariat\s+enregistre"
    r"|je\s+(?:conclus|enregistre)\s+(?:un|mon)\s+partenariat\s+enregistre)\b"
)
DEATH = r"\b(?:deces|decede|decedee|mort|morte)\b"
FIRST_DEGREE = (
    r"\b(?:(?<!beau-)(?<!grand-)pere|(?<!belle-)(?<!grand-)mere|conjoint|conjointe|epoux|epouse|(?<!petit-)fils|(?<!petite-)fille|mon\s+enfant)\b"
)
SECOND_DEGREE = (
    r"\b(?:frere|soeur|grand-pere|grand-mere|grands-parents|beau-frere|belle-soeur|beau-pere|belle-mere|petit-fils|petite-fille|petits-enfants)\b"
)
MOVING = r"\b(?:demenage|demenagent|demenagement|demenager|demenagerai|demenagerais|demenagerons|demenagerions|demenageons)\b"
OWN_MOVING = (
    r"\b(?:je\s+(?:(?:dois|devrai|souhaite)\s+|(?:vais|prevois)\s+(?:de\s+)?)?demenag(?:e|er|erai|erais)"
    r"|nous\s+(?:(?:devons|devrons|souhaitons)\s+|(?:allons|prevoyons)\s+(?:de\s+)?)?demenag(?:eons|er|erons|erions)|mon\s+demenagement|notre\s+demenagement)\b"
)
NUMBER = r"(-?\d+(?:[.,]\d+)?)"
SENIORITY = r"(?:de\s+service|d[' ]anciennete)"
AGE_PATTERNS = (
    rf"\bj[' ]?ai\s+{NUMBER}\s*ans?\b",
    rf"\ba\s+{NUMBER}\s*ans?\b(?!\s+{SENIORITY})",
    rf"\b(?:age)\s*(?:de|:|est\s+de)?\s*{NUMBER}\s*ans?\b",
    rf"\bagee?\s+de\s+{NUMBER}\s*ans?\b",
    rf"\bemploye?\s+de\s+{NUMBER}\s*ans?\b",
    rf"\b{NUMBER}\s*ans?\s+d[' ]age\b",
)
SERVICE_PATTERNS = (
    rf"\b{NUMBER}\s*(?:ans?|annees?)\s+{SENIORITY}\b",
    rf"\b(?:anciennete|service)\s*(?:de|:|est\s+de)?\s*{NUMBER}\s*(?:ans?|annees?)\b",
    rf"\b(?:compte|ayant|avec)\s+{NUMBER}\s*(?:ans?|annees?)\s+{SENIORITY}\b",
    rf"\b(?:cela|ca)\s+fait\s+{NUMBER}\s*(?:ans?|annees?)\s+que\s+(?:je\s+)?(?:travaille|travail|suis)\b",
    rf"\b(?:je\s+)?travaille\s+(?:ici\s+)?depuis\s+{NUMBER}\s*(?:ans?|annees?)\b",
    rf"\bj[' ]y\s+travaille\s+depuis\s+{NUMBER}\s*(?:ans?|annees?)\b",
    rf"\b(?:je\s+)?travaille\s+(?:dans|pour|au\s+sein\s+de)\s+(?:cette|la|l[' ])?\s*institution\s+depuis\s+{NUMBER}\s*(?:ans?|annees?)\b",
)
OVERVIEW = r"(?:types?|liste|differents?|categories?|lesquels?|inventaire|existe(?:nt)?)"
MEASURES = (
    "droit", "droits", "duree", "heure", "heures", "jour", "journee", "journees", "jours", "mois", "nombre", "quantite",
    "semaine", "semaines", "temps",
)
KNOWN_LEAVE = (
    r"\b(?:adoption|allaitement|deces|deuil|deménagement|demenagement|enfant|extraordinaire|familial|formation|grossesse|jeunesse|malade"
    r"|maladie|mariage|maternite|medical|militaire|naissance|parental|paternite|proche|sabbatique|service civil|sans solde|special)\b"
)
LEAVE_FOR = r"\bconges?\s+(?:(?:de|pour)\s+|(?:en cas|lors|suite)\s+de\s+|lie\s+a\s+)(?:(?:un|une|le|la|les|du|des|l')\s+)?\p{L}{3,}"
ENTITLEMENT = r"\b(?:combien|droit|duree|jours?|semaines?|prendre|obtenir|quel)\b"
KNOWN_RELATION = (
    r"\b(?:ami|amie|beau-frere|beau-pere|belle-mere|belle-soeur|collegue|compagnon|compagne|conjoint|conjointe|cousin|cousine|enfant"
    r"|epoux|epouse|femme|fille|fils|frere|grand-mere|grand-parent|grand-pere|maman|mari|mere|neveu|niece|oncle|papa|parent|partenaire"
    r"|pere|soeur|tante)\b"
)
OWN_RELATION = r"\b(?:mon|ma|mes|notre|nos)\s+(?!(?:famille|membre|personne|proche|proches)\b)\p{L}[\p{L}-]*"
NUMBER_WORD = (
    "(?:un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix|onze|douze|treize|quatorze|quinze|seize|vingt|vingts|trente|quarante"
    "|cinquante|soixante|cent)"
)
SEPARATOR = r"(?:\s*-\s*|\s+)"
# A run of number words that something joins to the next word or to a unit. It is possessive, so Java walks it in a loop: a greedy one
# takes stack for every word and ends the executor after some thousand of them.
NUMBER_RUN = rf"{NUMBER_WORD}(?=[\s-])(?:{SEPARATOR}(?:et{SEPARATOR})?{NUMBER_WORD}(?=[\s-]))*+"
# Not inside a run: what can be said from there, the run says from its first word.
RUN_OPENS = rf"(?<!(?<![A-Za-z0-9_]){NUMBER_WORD}[\s-])"
QUESTION_SIGNALS = (
    r"\b(combien|calcul|seuil|minimum|maximum|a partir de|plus de|moins de)\b",
    r"\b(age|anciennete|ans? de service|jours?|semaines?|mois|montant|pourcentage|salaire|vacances?)\b",
    r"-?\d+(?:[.,]\d+)?",
)
ANSWER_SIGNALS = (
    r"-?\d+(?:[.,]\d+)?\s*(?:jours?|ans?|semaines?|mois|%|chf|francs?)\b",
    rf"\b{RUN_OPENS}{NUMBER_RUN}\s+(?:jours?|ans?|semaines?|mois)\b",
)

_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_OPENS, _CLOSES = f"(?<!{_WORD})", f"(?!{_WORD})"


def _first(parsed) -> set[str] | None:
    """Characters a parsed pattern can begin with; None when they are not a short list or it may match nothing."""
    out: set[str] = set()
    for kind, value in parsed:
        kind = str(kind)
        if kind in ("AT", "ASSERT", "ASSERT_NOT"):
            continue
        if kind == "LITERAL":
            return out | {chr(value)}
        if kind == "IN" and all(str(k) == "LITERAL" or (str(k), str(v)) == ("CATEGORY", "CATEGORY_DIGIT") for k, v in value):
            return out.union(*["0123456789" if str(k) == "CATEGORY" else chr(v) for k, v in value])
        if kind == "SUBPATTERN":
            inner = _first(value[-1])
        elif kind == "BRANCH":
            firsts = [_first(branch) for branch in value[1]]
            inner = None if None in firsts else set().union(*firsts)
        elif kind == "MAX_REPEAT":
            inner = _first(value[2])
            if inner is not None and value[0] == 0:
                out |= inner
                continue
        else:
            return None
        return None if inner is None else out | inner
    return None


def _begins(text: str) -> str:
    """A look at the next character that any match of a pattern needs, or nothing: it is far cheaper than a look behind."""
    try:
        parsed = re._parser.parse(text)
    except re.error:
        return ""
    first = None if str(parsed[0][0]) == "BRANCH" else _first(parsed)
    return "" if not first else "(?=[" + "".join(sorted(re.escape(c) for c in first)) + "])"


@functools.cache
def pattern(text: str) -> str:
    """A fixed pattern with its word boundaries made ASCII.

    Beside a letter one look-around says the same as the full boundary and is
    much cheaper; it stays in full beside a sign, a percent or any letter.
    """
    begins = _begins(text) if text.startswith("\\b") else ""
    parts = text.split("\\b")
    out = parts[0]
    for after in parts[1:]:
        if "%" in text or after.startswith(("(-?", "([")):
            out += _BOUNDARY
        elif after and (after[0].isalpha() or after[0] == "(") and not after.startswith("(?!"):
            out += _OPENS
        else:
            out += _CLOSES
        out += after
    return begins + out


# A literal each pattern cannot match without, looked for first because that is far cheaper.
NEEDS = {
    ANNUAL[0]: ("vacance",), ANNUAL[1]: ("conge",), ANNUAL[2]: ("droit",), EXCEPTIONAL: ("conge",), MARRIAGE: ("mari", "partenariat"),
    OWN_MARRIAGE: ("mari", "partenariat"), DEATH: ("dece", "mort"), MOVING: ("demenag",), OWN_MOVING: ("demenag",), LEAVE_FOR: ("conge",),
    AGE_PATTERNS[0]: ("ai",), AGE_PATTERNS[2]: ("age",), AGE_PATTERNS[3]: ("age",), AGE_PATTERNS[4]: ("employ",), AGE_PATTERNS[5]: ("age",),
    SERVICE_PATTERNS[0]: ("service", "anciennete"), SERVICE_PATTERNS[1]: ("service", "anciennete"), SERVICE_PATTERNS[2]: ("service", "anciennete"),
    SERVICE_PATTERNS[3]: ("fait",), SERVICE_PATTERNS[4]: ("depuis",), SERVICE_PATTERNS[5]: ("depuis",), SERVICE_PATTERNS[6]: ("depuis",),
}


def _may_say(text: Column, fixed: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in NEEDS.get(fixed, ("",))])


def says(text: Column, *patterns: str) -> Column:
    """True when any of the patterns occurs in folded text."""
    tests = [_may_say(text, p) & text.rlike(pattern(p)) if p in NEEDS else text.rlike(pattern(p)) for p in patterns]
    return reduce(lambda a, b: a | b, tests)


def normalize_question(col: Column, longest: int = MAX_QUESTION) -> Column:
    """NFKC, single spaces, trimmed; null when shorter than 3 or longer than ``longest``."""
    return let(collapse(nfkc(col)), lambda t: F.when(F.length(t).between(MIN_QUESTION, longest), t))


def effective_question(question: Column, pending: Column) -> Column:
    """The question together with the one it completes; null beyond the length limit."""
    head = F.when(pending.startswith("Question initiale :"), pending).otherwise(F.concat(F.lit(FIRST_TURN), pending))
    joined = F.concat(head, F.lit("\n" + NEXT_TURN), question)
    return F.when(pending.isNull(), question).otherwise(F.when(F.length(joined) <= MAX_EFFECTIVE, joined))


def validate_questions(df: DataFrame, body: str = "body") -> DataFrame:
    """Check request bodies (JSON text) and add question, pending, effective and status."""
    keys = F.array_sort(F.json_object_keys(body))
    field = lambda name: F.variant_get(F.try_parse_json(body), f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.variant_get(F.try_parse_json(body), f"$.{name}", "variant"))
    rows = df.withColumns(
        {
            "question": F.when(kind("question") == "STRING", normalize_question(field("question"))),
            "pending_question": F.when(kind("pending_question") == "STRING", normalize_question(field("pending_question"), MAX_PENDING)),
            "_keys": F.array_join(keys, ","),
        }
    )
    rows = rows.withColumn("effective_question", effective_question(F.col("question"), F.col("pending_question")))
    ok_keys = F.coalesce(F.col("_keys").isin("question", "pending_question,question"), F.lit(False))
    status = first_match(
        (~ok_keys, "invalid_request"),
        (F.col("question").isNull(), "invalid_question"),
        ((F.col("_keys") != "question") & F.col("pending_question").isNull(), "invalid_pending_question"),
        (F.col("effective_question").isNull(), "question_too_long"),
        default="ok",
    )
    return rows.withColumn("request_status", status).drop("_keys")


def effective_questions(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """Every user turn together with the turns of its conversation before it.

    Running lengths tell first which turns stay within the limit, so the text
    gathered per conversation is bounded by that limit.
    """
    asked = turns.withColumn("question", normalize_question(F.col(text))).where("question is not null")
    size = F.length("question") + len(NEXT_TURN) + 1
    bucket = F.floor(F.col(order) / 256)
    measured = with_running(asked, [conversation], [order], bucket, {"_n": F.lit(1), "_size": size})
    measured = measured.withColumn("_size", F.col("_size") - len(NEXT_TURN) - 1 + len(FIRST_TURN))
    fits = (F.col("_n") == 1) | (F.col("_size") <= MAX_EFFECTIVE)
    w = Window.partitionBy(conversation).orderBy(order)
    seen = F.collect_list("question").over(w)
    told = F.concat(F.lit(FIRST_TURN), F.array_join(seen, "\n" + NEXT_TURN))
    kept = measured.where(fits).withColumn("effective_question", F.when(F.col("_n") == 1, F.col("question")).otherwise(told))
    late = measured.where(~fits).withColumn("effective_question", F.lit(None).cast("string"))
    return kept.unionByName(late).withColumnRenamed("_n", "turn_number").drop("_size")


def whole_questions(turns: DataFrame, conversation: str, order: str, text: str) -> DataFrame:
    """Every turn with its whole question and effective text, whatever their lengths; the length verdicts stand beside them.

    An effective text is that of all turns up to its own, so a conversation's output grows with the square of its turns.
    """
    asked = turns.withColumn("question", collapse(nfkc(F.col(text))))
    w = Window.partitionBy(conversation).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    said = asked.withColumns({
        "turn_number": F.count(F.lit(1)).over(w), "_seen": F.collect_list(F.when(F.col("question") != "", F.col("question"))).over(w),
    })
    told = F.concat(F.lit(FIRST_TURN), F.array_join("_seen", "\n" + NEXT_TURN))
    size = F.length("question")
    status = first_match(
        (F.coalesce(size, F.lit(0)) < MIN_QUESTION, "too_short"), (size > MAX_QUESTION, "too_long"), default="ok",
    )
    out = said.withColumns({"effective_question": F.when(F.size("_seen") > 1, told).otherwise(F.get("_seen", F.lit(0))), "question_status": status})
    long = F.coalesce((F.size("_seen") > 1) & (F.length("effective_question") > MAX_EFFECTIVE), F.lit(False))
    return out.withColumn("effective_status", F.when(long, "too_long").otherwise("ok")).drop("_seen")


def targets_annual(text: Column) -> Column:
    return says(text, *ANNUAL)


def targets_exceptional(text: Column) -> Column:
    return says(text, EXCEPTIONAL, MARRIAGE, MOVING) | (says(text, DEATH) & says(text, FIRST_DEGREE, SECOND_DEGREE))


def detect_intent(text: Column) -> Column:
    """Template a folded question is about; null when none or both claim it."""
    annual, exceptional = targets_annual(text), targets_exceptional(text)
    return F.when(annual, F.when(~exceptional, ANNUAL_LEAVE)).otherwise(F.when(exceptional, EXCEPTIONAL_LEAVE))


def route_question(text: Column) -> Column:
    """Clarification to ask before searching (folded text), or null to go on."""
    return let(text, _route)


def _route(text: Column) -> Column:
    overview = says(text, rf"\b{OVERVIEW}\b.*\bconges?\b", rf"\bconges?\b.*\b{OVERVIEW}\b")
    objects = F.regexp_extract_all(text, F.lit(pattern(r"\b([\p{L}-]+)\s+de\s+conges?\b")), F.lit(1))
    specified = F.size(F.array_except(objects, F.array(*[F.lit(m) for m in MEASURES]))) > 0
    entitlement = says(text, ENTITLEMENT) | (F.size(F.split(text, "\\s+")) <= 4)
    bereaved = says(text, r"\b(?:deces|deuil)\b") & entitlement
    proceeds = ~says(text, r"\bconges?\b") | targets_annual(text) | targets_exceptional(text) | overview | specified
    return (
        F.when(proceeds, F.lit(None).cast("string"))
        .when(bereaved & ~says(text, KNOWN_RELATION, OWN_RELATION), RELATION_CLARIFICATION)
        .when(says(text, KNOWN_LEAVE, LEAVE_FOR) | ~entitlement, F.lit(None).cast("string"))
        .otherwise(TYPE_CLARIFICATION)
    )


FACT = "struct<status:string,number_value:double,category_value:string,errors:array<string>>"


def number_mentions(text: Column, patterns: tuple[str, ...]) -> Column:
    """Every number the patterns find in folded text, in their order, as it is written."""
    none = F.array().cast("array<string>")
    # Neighbours that need the same literal share the look for it.
    found = []
    for needs, some in itertools.groupby(patterns, lambda p: NEEDS.get(p)):
        some = list(some)
        hits = [F.regexp_extract_all(text, F.lit(pattern(p)), F.lit(1)) for p in some]
        hits = hits[0] if len(hits) == 1 else F.flatten(F.array(*hits))
        found.append(F.when(_may_say(text, some[0]), hits).otherwise(none) if needs else hits)
    return F.when(text.rlike("[0-9]"), F.flatten(F.array(*found))).otherwise(none)


def numbers_of(written: Column) -> Column:
    """Written numbers as doubles. The list is parsed as one text, which is compiled; element by element it would be interpreted."""
    parsed = F.split(F.replace(F.array_join(written, " "), F.lit(","), F.lit(".")), " ").try_cast("array<double>")
    return F.when(F.size(written) > 0, parsed).when(written.isNotNull(), F.array().cast("array<double>"))


def reason_mentions(text: Column) -> Column:
    """The reasons of an exceptional leave; only the person's own marriage or move counts."""
    death = says(text, DEATH)
    signals = {
        "marriage": says(text, OWN_MARRIAGE),
        "death_first_degree": death & says(text, FIRST_DEGREE),
        "death_second_degree": death & says(text, SECOND_DEGREE),
        "moving": says(text, OWN_MOVING),
    }
    none = F.array().cast("array<string>")
    return F.concat(*[F.when(cond, F.array(F.lit(name))).otherwise(none) for name, cond in signals.items()])


# The closed registry: what a template may name, and what each name reads from a folded question.
NUMBER_EXTRACTORS = {"age_years_fr_v1": AGE_PATTERNS, "service_years_fr_v1": SERVICE_PATTERNS}
CATEGORY_EXTRACTORS = {"leave_reason_fr_v1": reason_mentions}
EXTRACTORS = (*NUMBER_EXTRACTORS, *CATEGORY_EXTRACTORS)


def read_questions(questions: DataFrame, text: str = "question", intent: str = "template_key", every: bool = False) -> DataFrame:
    """Add the template a question is about (``intent``) and ``mentions``: what each extractor finds in it.

    A question is folded and searched once, before any join; which of the mentions count is for the template to say
    (:func:`extract_facts`). Mentions of a question about no template are read only if ``every`` is set. The columns come out of
    generators, so that no filter on them is pushed below and runs the patterns a second time. No step holds a higher-order
    function, so all of them are compiled.
    """
    t = F.col("_folded")
    once = lambda df, *columns: df.select("*", F.inline(F.array(F.struct(*columns))))
    aimed = once(with_folded(questions, text, "_folded"), detect_intent(t).alias(intent))
    wanted = lambda found: found if every else F.when(F.col(intent).isNotNull(), found)
    said = aimed
    for name, p in NUMBER_EXTRACTORS.items():
        said = once(said, wanted(number_mentions(t, p)).alias(f"_{name}"))
    said = once(said, *[wanted(f(t)).alias(f"_{name}") for name, f in CATEGORY_EXTRACTORS.items()])
    read = F.struct(*[numbers_of(F.col(f"_{n}")).alias(n) for n in NUMBER_EXTRACTORS], *[F.col(f"_{n}").alias(n) for n in CATEGORY_EXTRACTORS])
    return said.withColumn("mentions", wanted(read)).drop("_folded", *[f"_{n}" for n in EXTRACTORS])


def _judge_fact(spec: Column, said: Column) -> Column:
    """One fact of a template from the mentions of a question: value, ok / invalid / conflicting, errors."""
    key = spec["fact_key"]
    none = F.array().cast("array<string>")

    def fine(n: Column) -> Column:
        whole = ~F.coalesce(spec["integer_only"], F.lit(False)) | (n == F.floor(n))
        low = spec["minimum_number"].isNull() | (n >= spec["minimum_number"])
        high = spec["maximum_number"].isNull() | (n <= spec["maximum_number"])
        return F.coalesce(whole & low & high, F.lit(False))

    def fact(number: Column) -> Column:
        parts = {"status": F.lit("ok"), "number_value": number, "category_value": F.lit(None).cast("string"), "errors": none}
        return F.struct(*[part.alias(name) for name, part in parts.items()]).cast(FACT)

    def conclude(x: Column) -> Column:
        good, bad = x["good"], x["bad"]
        many = F.size(good) + F.size(x["named"]) > 1
        clash = F.when(many, F.array(F.concat(F.lit("conflicting_"), key))).otherwise(none)
        return F.struct(
            F.when(F.size(bad) > 0, "invalid").when(many, "conflicting").otherwise("ok").alias("status"),
            F.when(F.size(good) == 1, F.get(good, F.lit(0))).alias("number_value"),
            F.when(F.size(x["named"]) == 1, F.get(x["named"], F.lit(0))).alias("category_value"), F.concat(bad, clash).alias("errors"),
        ).cast(FACT)

    def numbers(found: Column) -> Column:
        bad = F.transform(F.filter(found, lambda n: ~fine(n)), lambda _: F.concat(key, F.lit("_out_of_range")))
        several = let(F.struct(F.array_distinct(F.filter(found, fine)).alias("good"), bad.alias("bad"), none.alias("named")), conclude)
        return F.when((F.size(found) == 1) & fine(F.get(found, F.lit(0))), fact(F.get(found, F.lit(0)))).otherwise(several)

    def categories(found: Column) -> Column:
        named = F.coalesce(F.array_intersect(found, spec["categories"]), none)
        return let(F.struct(F.array().cast("array<double>").alias("good"), none.alias("bad"), named.alias("named")), conclude)

    # A fact nobody said is most of them, and nothing of it is worked out.
    unsaid = fact(F.lit(None).cast("double"))
    readings = {n: numbers for n in NUMBER_EXTRACTORS} | {n: categories for n in CATEGORY_EXTRACTORS}
    cases = [(spec["extractor_key"] == n, F.when(F.size(said[n]) > 0, reading(said[n])).otherwise(unsaid)) for n, reading in readings.items()]
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])).otherwise(unsaid)


def template_traits(template: Column) -> Column:
    """What facts need to know of a template alone: the extractor outside the registry as an error code, and whether facts are listed twice."""
    strange = lambda f: ~F.coalesce(f["extractor_key"].isin(*EXTRACTORS), F.lit(False))
    stray = F.get(F.filter(template["facts"], strange), F.lit(0))["extractor_key"]
    unknown = F.when(template["facts"].isNull() | F.exists(template["facts"], strange), F.concat(F.lit("unknown_extractor_"), F.coalesce(stray, F.lit(""))))
    keys = F.transform(template["facts"], lambda f: f["fact_key"])
    plain = (F.size(F.array_distinct(keys)) == F.size(keys)) & F.forall(keys, lambda k: k.isNotNull())
    return F.struct(unknown.alias("unknown"), F.coalesce(plain, F.lit(False)).alias("plain"))


def extract_facts(questions: DataFrame, template: str = "template", mentions: str = "mentions") -> DataFrame:
    """Add ``facts`` (fact key → values), ``facts_status`` and ``facts_errors``: the facts the template lists, within its bounds.

    ``template`` holds the nested template of each row, ``mentions`` what :func:`read_questions` found. An extractor outside the
    registry, or no template, makes the extraction invalid. Of facts listed twice under one key the last counts.
    """
    t, said = F.col(template), F.col(mentions)
    rows = questions if "_traits" in questions.columns else questions.withColumn("_traits", template_traits(t))
    unknown, plain = F.col("_traits.unknown"), F.col("_traits.plain")
    judged = F.transform(t["facts"], lambda f: F.struct(f["fact_key"].alias("key"), _judge_fact(f, said).alias("value")))
    rows = rows.withColumn("_facts", F.when(unknown.isNull(), judged))
    statuses = F.col("_facts.value.status")
    status = (
        F.when(unknown.isNotNull() | F.array_contains(statuses, "invalid"), "invalid")
        .when(F.array_contains(statuses, "conflicting"), "conflicting")
        .otherwise("ok")
    )
    again = lambda f, i: F.exists(F.slice("_facts", i + 2, F.size("_facts")), lambda g: g["key"] == f["key"])
    last = F.when(plain, F.col("_facts")).otherwise(F.filter("_facts", lambda f, i: ~again(f, i)))
    errors = F.when(unknown.isNotNull(), F.array(unknown)).otherwise(F.flatten(F.col("_facts.value.errors")))
    return rows.withColumns({"facts": F.map_from_entries(last), "facts_status": status, "facts_errors": errors}).drop("_facts", "_traits")


def needs_rules(question: Column, answer: Column) -> Column:
    """Whether a question or a generated answer is about amounts that rules must settle."""
    asked = let(fold(question), lambda t: says(t, *QUESTION_SIGNALS))
    return asked | let(fold(F.coalesce(answer, F.lit(""))), lambda t: says(t, *ANSWER_SIGNALS))


def with_continuation(df: DataFrame, result: str = "result", effective: str = "effective_question") -> DataFrame:
    """Clarifications carry the effective question forward as the next pending one."""
    return df.withColumn("pending_question", F.when(F.col(result) == "needs_clarification", F.col(effective)))
