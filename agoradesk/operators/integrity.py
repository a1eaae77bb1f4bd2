"""Integrity of rule sets against their documents, templates and source passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.functions.columns import compare
from agoradesk.operators.lifecycle import OPEN_RULES

# Term signatures of the exceptional-leave template.
SIGNATURES = {
    "marriage": (("mariage", "partenariat"), ()),
    "death_first_degree": (
        ("père", "mere", "mère", "conjoint", "époux", "epoux", "épouse", "epouse", "enfant", "fils", "fille"),
        ("beau-père", "beau-pere", "belle-mère", "belle-mere", "grand-père", "grand-pere", "grand-mère", "grand-mere", "petit-fils", "petite-fille"),
    ),
    "death_second_degree": (
        ("frère", "frere", "soeur", "sœur", "grand-père", "grand-pere", "grand-mère", "grand-mere", "beau-frère", "beau-frere", "belle-soeur",
         "belle-sœur", "beau-père", "beau-pere", "belle-mère", "belle-mere", "petit-fils", "petite-fille"),
        (),
    ),
    "moving_default": (("déménagement", "demenagement"), ()),
}
#: Parts that the requests of one tenant and template are dealt over when they meet its rule sets.
_DEALT = 16
PASSAGE = ["passage_id", "document_id", "institution_id"]
PRINTED_PAIR = "(?<![0-9])(?=([0-9]+[^0-9][0-9]+)(?![0-9]))"
DAYS_WORD = "(\\A|[^\\p{L}])jours?([^\\p{L}]|\\z)"


def signature_table(spark, template_version_id: str) -> DataFrame:
    """The fixed signatures as a table: one row per category, one for the default rule."""
    rows = [
        (template_version_id, key, "default_rule" if key == "moving_default" else "category_value", None if key == "moving_default" else "leave_reason",
         None if key == "moving_default" else key, list(required), list(forbidden))
        for key, (required, forbidden) in SIGNATURES.items()
    ]
    return spark.createDataFrame(
        rows, "template_version_id string, signature_key string, match_kind string, fact_key string, category_value string, required array<string>, forbidden array<string>"
    )


def matches_signature(content: Column, required: Column, forbidden: Column) -> Column:
    """Any required term and no forbidden one, as lower-cased substrings."""
    text = F.lower(content)
    has = lambda terms: F.exists(terms, lambda t: F.contains(text, F.lower(t)))
    return has(required) & ~has(forbidden)


def match_signatures(passages: DataFrame, signatures: dict = SIGNATURES) -> DataFrame:
    """(passage, signature) rows that match. The signatures are a fixed short list, held in the expression."""
    words = lambda terms: F.array(*[F.lit(t) for t in terms]).cast("array<string>")
    hits = [F.when(matches_signature(F.col("content"), words(r), words(f)), F.lit(key)) for key, (r, f) in signatures.items()]
    return passages.withColumn("signature_key", F.explode(F.array_compact(F.array(*hits))))


def outcome_text(value: Column) -> Column:
    """Outcome as a number a passage would print; the scale must be present before zeros go."""
    return F.regexp_replace(value.cast("decimal(18,6)").cast("string"), "\\.?0+$", "")


def passage_features(passages: DataFrame, signatures: DataFrame) -> DataFrame:
    """What rules ask of a passage, read off its text once.

    ``_printed`` holds the numbers as printed: runs of digits, and any two runs with one sign between them. ``_hits`` holds the signatures that
    match; these are a closed list of the templates, held in one value.
    """
    listed = signatures.agg(F.collect_list(F.struct("template_version_id", "signature_key", "required", "forbidden"))).scalar()
    read = passages.select(
        *PASSAGE, F.col("content_sha256").alias("_now"), F.lower("content").alias("_low"),
        F.concat(
            F.regexp_extract_all("content", F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all("content", F.lit(PRINTED_PAIR), F.lit(1))
        ).alias("_printed"), listed.alias("_listed"),
    )
    has = lambda terms: F.exists(terms, lambda t: F.contains("_low", F.lower(t)))
    hits = F.transform(
        F.filter("_listed", lambda s: has(s["required"]) & ~has(s["forbidden"])), lambda s: _signature(s["template_version_id"], s["signature_key"])
    )
    return read.select(*PASSAGE, "_now", F.array_distinct("_printed").alias("_printed"), F.rlike("_low", F.lit(DAYS_WORD)).alias("_days"), hits.alias("_hits"))


def _signature(template: Column, key: Column) -> Column:
    return F.concat_ws("\x1f", template, key)


def _templates(templates: DataFrame, template_facts: DataFrame, registry: DataFrame, signatures: DataFrame, constraints: DataFrame) -> DataFrame:
    """One row per template version: whether it runs, uses only registered keys, its signatures and its constraints."""
    version = F.col("template_version_id")
    key = lambda kind, name: F.struct(F.lit(kind).alias("key_type"), F.col(name).alias("runtime_key"))
    used = templates.select(version, "status", F.explode(F.array(
        key("intent_detector", "detector_key"), key("renderer", "renderer_key"), key("aggregation_strategy", "aggregation_strategy"))).alias("_key"))
    used = used.unionByName(template_facts.select(version, key("fact_extractor", "extractor_key").alias("_key")), allowMissingColumns=True)
    known = registry.select(F.struct("key_type", "runtime_key").alias("_key"), F.lit(True).alias("_known"))
    rows = used.join(known, "_key", "left").select(version, "status", F.col("_known").isNull().alias("_stray"))
    rows = rows.unionByName(signatures.select(version, F.struct("signature_key", "match_kind", "fact_key", "category_value").alias("_sign")), allowMissingColumns=True)
    rows = rows.unionByName(constraints.select(version, F.struct("left_fact_key", "comparator", "right_fact_key").alias("_bound")), allowMissingColumns=True)
    return rows.groupBy("template_version_id").agg(
        F.bool_or(F.col("status").isin("published", "retired")).alias("_runs"), F.bool_or("_stray").alias("_stray"),
        F.collect_set("_sign").alias("_signs"), F.collect_set("_bound").alias("_bounds"),
    )


def _rule_records(rules: DataFrame, groups: DataFrame, conditions: DataFrame) -> DataFrame:
    """One row per rule with its groups and conditions, which the model bounds to some dozens."""
    held = groups.select("rule_id", F.col("group_id").alias("_group"))
    said = conditions.select("rule_id", F.struct("group_id", "fact_key", "number_value", "category_value").alias("_said"))
    rows = held.unionByName(said, allowMissingColumns=True)
    shape = rows.groupBy("rule_id").agg(F.collect_list("_group").alias("_groups"), F.collect_list("_said").alias("_said"))
    found = rules.select("rule_id", "rule_set_id", "outcome_value", "is_default").join(shape, "rule_id", "left")
    return found.withColumns({c: F.coalesce(c, F.array().cast(shape.schema[c].dataType)) for c in ("_groups", "_said")})


def _broken(bounds: Column, said: Column) -> Column:
    """Whether two conditions of one group contradict a constraint of the template."""
    def pair(bound: Column, left: Column) -> Column:
        against = lambda right: (right["group_id"] == left["group_id"]) & (right["fact_key"] == bound["right_fact_key"]) & (
            ~compare(left["number_value"], bound["comparator"], right["number_value"]))
        return (left["fact_key"] == bound["left_fact_key"]) & F.exists(said, against)

    return F.coalesce(F.exists(bounds, lambda bound: F.exists(said, lambda left: pair(bound, left))), F.lit(False))


def inspect_integrity(
    sets: DataFrame, docs: DataFrame, templates: DataFrame, template_facts: DataFrame, registry: DataFrame, rules: DataFrame, groups: DataFrame,
    conditions: DataFrame, sources: DataFrame, passages: DataFrame, signatures: DataFrame, constraints: DataFrame, asked: DataFrame | None = None,
) -> DataFrame:
    """Issues of every rule set, one row each: rule_set_id, rule_id (null for the set), code.

    With ``asked`` (rule_set_id) only these are inspected, and an id without a rule set is ``rule_set_not_found``. Every table is read once:
    a rule becomes one row with its groups and conditions, meets its set and template, then its sources with what their texts
    print, and all codes of a rule are read off that row. What a rule adds to its set travels on as a count.
    """
    none = F.lit(None).cast(rules.schema["rule_id"].dataType)
    base = sets.select("rule_set_id", "document_id", "institution_id", "template_version_id", "result_unit", F.lit(True).alias("_set"))
    if asked is not None:
        base = asked.select("rule_set_id").distinct().join(base, "rule_set_id", "left")
    eligible = docs.where(F.col("status").isin("ready", "active")).select("document_id", "institution_id", F.lit(True).alias("_eligible"))
    kinds = _templates(templates, template_facts, registry, signatures, constraints)
    known = base.join(eligible, ["document_id", "institution_id"], "left").join(kinds, "template_version_id", "left")
    code = lambda cond, name: F.when(cond, F.lit(name))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    of_set = F.when(F.col("_set").isNull(), F.array(F.lit("rule_set_not_found"))).otherwise(F.array_compact(F.array(
        code(no("_eligible"), "document_not_eligible"), code(no("_runs"), "template_not_executable"), code(F.col("_stray"), "runtime_registry_mismatch"))))
    held = known.select("rule_set_id", "_set", "template_version_id", "result_unit", "_signs", "_bounds", of_set.alias("_of_set")).join(
        _rule_records(rules, groups, conditions), "rule_set_id", "left")

    grouped = F.size("_groups") > 0
    empty = F.exists("_groups", lambda g: ~F.exists("_said", lambda c: c["group_id"] == g))
    fits = lambda s: ((s["match_kind"] == "default_rule") & F.col("is_default")) | (
        (s["match_kind"] == "category_value") & F.exists("_said", lambda c: (c["fact_key"] == s["fact_key"]) & (c["category_value"] == s["category_value"])))
    signed = F.transform(F.filter("_signs", fits), lambda s: _signature(F.col("template_version_id"), s["signature_key"]))
    shown = outcome_text(F.col("outcome_value"))
    rule = held.select(
        "rule_set_id", "rule_id", "_set", "_of_set", "is_default", "result_unit", code((F.col("is_default") == grouped) | empty, "invalid_rule_structure").alias("_shape"),
        _broken(F.col("_bounds"), F.col("_said")).alias("_breaks"), F.coalesce(signed, F.array().cast("array<string>")).alias("_signed"),
        F.when(shown == "", "0").otherwise(shown).alias("_value"))

    read = sources.select("rule_id", "rule_set_id", *PASSAGE, "content_sha256").join(passage_features(passages, signatures), PASSAGE, "left")
    met = rule.join(read.select("rule_id", "rule_set_id", F.lit(True).alias("_source"), "content_sha256", "_now", "_printed", "_days", "_hits"), ["rule_id", "rule_set_id"], "left")
    shape = F.concat(F.lit("^"), F.col("_value"), F.lit("$"))
    printed = F.array_contains("_printed", F.col("_value")) | (F.contains("_value", F.lit(".")) & F.exists("_printed", lambda p: F.regexp_like(p, shape)))
    stated = F.coalesce(printed & ((F.col("result_unit") != "days") | F.col("_days")), F.lit(False))
    first = lambda c: F.first(c).alias(c)
    judged = met.groupBy("rule_set_id", "rule_id").agg(
        *[first(c) for c in ("_set", "_of_set", "is_default", "_shape", "_breaks", "_signed")], F.count("_source").alias("_sources"),
        F.bool_or(F.col("content_sha256") != F.col("_now")).alias("_changed"), F.bool_or(stated).alias("_stated"),
        F.bool_or(stated & F.coalesce(F.arrays_overlap("_hits", "_signed"), F.lit(False))).alias("_stated_fit"))
    sourced, by_sign = F.col("_sources") > 0, F.size("_signed") > 0
    ungrounded = sourced & ~F.when(by_sign, F.col("_stated_fit")).otherwise(F.col("_stated"))
    of_rule = F.array_compact(F.array(
        F.col("_shape"), code(~sourced, "missing_rule_sources"), code(sourced & F.col("_changed"), "source_changed"),
        code(ungrounded & by_sign, "categorical_source_mismatch"), code(ungrounded & ~by_sign, "value_or_unit_not_in_source")))
    codes = F.when(F.col("rule_id").isNull() | F.col("_set").isNull(), F.array().cast("array<string>")).otherwise(of_rule)

    # a rule's own issues pass through; its default flag and broken constraint are added up per set under a null code
    parts = judged.select(
        "rule_set_id", "rule_id", "_set", "_of_set", F.coalesce(F.col("is_default").cast("int"), F.lit(0)).alias("_defaults"), F.coalesce("_breaks", F.lit(False)).alias("_breaks"),
        F.explode(F.concat(codes, F.array(F.lit(None).cast("string")))).alias("code"))
    parts = parts.withColumn("rule_id", F.when(F.col("code").isNotNull(), F.col("rule_id")))
    summed = parts.groupBy("rule_set_id", "rule_id", "code").agg(first("_set"), first("_of_set"), F.sum("_defaults").alias("_defaults"), F.bool_or("_breaks").alias("_breaks"))
    sets_too = F.array_compact(F.concat(F.col("_of_set"), F.array(
        code(F.col("_set") & (F.col("_defaults") != 1), "invalid_default_rule_count"), code(F.col("_set") & F.col("_breaks"), "template_fact_constraint_failed"))))
    out = summed.select("rule_set_id", "rule_id", F.explode(F.when(F.col("code").isNotNull(), F.array("code")).otherwise(sets_too)).alias("code"))
    return out.select("rule_set_id", F.coalesce("rule_id", none).alias("rule_id"), "code")


def integrity_summary(sets: DataFrame, issues: DataFrame) -> DataFrame:
    """Validity per set with its distinct issue codes; the code list is closed, so the array is short."""
    codes = issues.groupBy("rule_set_id").agg(F.count("*").alias("issue_count"), F.array_sort(F.collect_set("code")).alias("issue_codes"))
    out = sets.join(codes, "rule_set_id", "left")
    return out.withColumns({"issue_count": F.coalesce("issue_count", F.lit(0)), "valid": F.col("issue_codes").isNull()})


def rule_context(sets: DataFrame, docs: DataFrame, sources: DataFrame, requests: DataFrame) -> DataFrame:
    """Validated sets of active documents a request needs: by template, or by a passage it holds.

    requests: request_id, institution_id, template_key (nullable), passage_ids.

    Rows are as many as requests times sets of their template, so these pairs are never compared with each other: a request id of one tenant
    and template meets a set of one tenant and key at most once, and the sets found by passage leave out those of its template. Only these
    and the pairs of ids that stand for several are made distinct, after their requests are dealt: before, hardly any pair repeats. Requests
    of one template are dealt over ``_DEALT`` parts.
    """
    live = docs.where("status = 'active'").select("document_id", "institution_id")
    usable = sets.where("status = 'validated'").join(live, ["document_id", "institution_id"], "left_semi").select("institution_id", "rule_key", "rule_set_id").distinct()
    usable = usable.withColumn("_many_sets", F.count(F.lit(1)).over(Window.partitionBy("rule_set_id")) > 1)
    place = F.struct("institution_id", "template_key")
    several = requests.groupBy(F.col("request_id").alias("_id")).agg(F.min(place).alias("_least"), F.max(place).alias("_most")).where(~F.col("_least").eqNullSafe(F.col("_most")))
    asked = requests.join(several.select("_id", F.lit(True).alias("_several")), F.col("request_id").eqNullSafe(F.col("_id")), "left").withColumn("_many_asked", F.coalesce("_several", F.lit(False)))

    by_key = asked.where("template_key is not null").select("request_id", "institution_id", F.col("template_key").alias("rule_key"), "_many_asked").distinct()
    by_key = by_key.withColumn("_part", F.pmod(F.xxhash64("request_id"), F.lit(_DEALT)))
    dealt = usable.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_DEALT - 1).cast("long"))))
    pairs = lambda asks, kept: by_key.where(asks).join(dealt.where(kept), ["institution_id", "rule_key", "_part"]).select("request_id", "rule_set_id")

    cited = sources.select("passage_id", "institution_id", "rule_set_id").join(usable, ["rule_set_id", "institution_id"]).distinct()
    held = requests.select("request_id", "institution_id", "template_key", F.explode(F.array_distinct("passage_ids")).alias("passage_id"))
    other = held.join(cited, ["passage_id", "institution_id"]).where("not (rule_key <=> template_key) or rule_key is null")
    again = pairs("_many_asked", "true").unionByName(pairs("not _many_asked", "_many_sets")).unionByName(other.select("request_id", "rule_set_id"))
    return pairs("not _many_asked", "not _many_sets").unionByName(again.repartition("request_id").distinct())


def protected_passages(sets: DataFrame, sources: DataFrame, statuses: tuple[str, ...] = OPEN_RULES) -> DataFrame:
    """(passage, unit) pairs behind any open or validated rule set; units are kept apart."""
    open_sets = sets.where(F.col("status").isin(*statuses)).select("rule_set_id", "institution_id", "result_unit")
    return sources.join(open_sets, ["rule_set_id", "institution_id"]).select("institution_id", "passage_id", "result_unit").distinct()


def protected_report(edits: DataFrame, sets: DataFrame, sources: DataFrame) -> DataFrame:
    """Passage edits that touch a source of an approved or validated set."""
    frozen = protected_passages(sets, sources, ("approved", "validated")).select("institution_id", "passage_id").distinct()
    return edits.join(frozen, ["institution_id", "passage_id"], "left_semi").withColumn("code", F.lit("protected_rule_source_immutable"))
