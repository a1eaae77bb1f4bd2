"""Rule governance: edits, confirmations, rejections, revisions and cascades as tables of operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match, is_uuid, labelled, plural, number_text, uuid_from
from agoradesk.functions.regexes import KEY, UUID
from agoradesk.operators.lifecycle import OPEN_RULES
from agoradesk.operators.quality import filter_optional

# Labels, actions, reasons, operators, limits.
STATUS_LABELS = {
    "proposed": "À vérifier", "needs_attention": "Correction nécessaire", "approved": "Approuvée, en attente d’activation",
    "validated": "Active", "rejected": "Rejetée", "invalidated": "Remplacée ou retirée",
}
STATUS_ACTIONS = {
    "proposed": "confirm_or_reject", "needs_attention": "correct_or_reject", "approved": "activate_document", "validated": "create_revision",
}
ACTION_LABELS = {
    "proposed": "Vérifier et approuver", "needs_attention": "Corriger", "approved": "Activer le document", "validated": "Créer une révision",
}
OPERATOR_LABELS = {
    "=": "est égal à", "!=": "est différent de", "<": "est inférieur à", "<=": "est inférieur ou égal à", ">": "est supérieur à",
    ">=": "est supérieur ou égal à",
}
REJECTIONS = ("incorrect_values", "incorrect_or_insufficient_sources", "not_applicable_to_institution", "wrong_template", "other")
EDITABLE = ("proposed", "needs_attention", "approved")
ACTION_KEYS = {
    "list": ("action", "document_id", "template_key", "statuses", "action_required", "cursor", "limit"),
    "detail": ("action", "rule_set_id"), "precheck": ("action", "rule_set_id"), "create_revision": ("action", "rule_set_id"),
    "simulate": ("action", "rule_set_id", "question"),
    "history": ("action", "rule_set_id", "cursor", "limit"),
    "save": ("action", "rule_set_id", "expected_revision_number", "operation_id", "rules"),
    "confirm": ("action", "rule_set_id", "expected_revision_number", "operation_id", "confirmation"),
    "reject": ("action", "rule_set_id", "expected_revision_number", "operation_id", "reason_code", "rejection_note"),
}
EDIT_BODY = (
    "struct<action:string,rule_set_id:string,document_id:string,template_key:string,statuses:array<string>,cursor:string,limit:double,question:string,"
    "expected_revision_number:double,operation_id:string,confirmation:boolean,reason_code:string,rejection_note:string,rules:array<struct<rule_id:string,"
    "outcome_value:double,is_default:boolean,display_order:double,label:string,condition_groups:array<struct<display_order:double,conditions:array<struct<"
    "fact_key:string,comparator:string,fact_value_type:string,number_value:double,category_value:string>>>>,source_passage_ids:array<string>>>>"
)


def with_rule_action(df: DataFrame, status: str = "status") -> DataFrame:
    return df.withColumn("action_required", labelled(F.col(status), STATUS_ACTIONS))


def with_labels(df: DataFrame, status: str = "status") -> DataFrame:
    s = F.col(status)
    return df.withColumns({"status_label": labelled(s, STATUS_LABELS, "Statut inconnu"), "action_label": labelled(s, ACTION_LABELS)})


def outcome_label(value: Column, unit: Column) -> Column:
    return F.when(unit == "days", F.concat(number_text(value), F.lit(" "), plural(value, "jour"))).otherwise(F.concat_ws(" ", number_text(value), unit))


def condition_label(fact_key: Column, fact_label: Column, comparator: Column, number: Column, category: Column, category_label: Column) -> Column:
    op = labelled(comparator, OPERATOR_LABELS)
    at_least = comparator == ">="
    return (
        F.when(category.isNotNull(), F.concat_ws(" ", fact_label, op, F.coalesce(category_label, category)))
        .when((fact_key == "age_years") & at_least, F.concat(F.lit("Dès "), number_text(number), F.lit(" ans")))
        .when((fact_key == "service_years") & at_least, F.concat(F.lit("Dès "), number_text(number), F.lit(" ans de service")))
        .otherwise(F.concat_ws(" ", fact_label, op, number_text(number)))
    )


def _whole(col: Column, low: float, high: float) -> Column:
    return F.coalesce((col == F.floor(col)) & col.between(low, high), F.lit(False))


def _good_condition(c: Column) -> Column:
    typed = F.when(c["fact_value_type"] == "number", c["number_value"].isNotNull() & c["category_value"].isNull()).when(
        c["fact_value_type"] == "category", c["number_value"].isNull() & c["category_value"].rlike(f"^{KEY}\\z"))
    return F.coalesce(c["fact_key"].rlike(f"^{KEY}\\z") & c["comparator"].isin(*OPERATOR_LABELS) & typed, F.lit(False))


def _good_group(g: Column) -> Column:
    return _whole(g["display_order"], 0, 1_000) & F.coalesce(F.size(g["conditions"]).between(1, 20) & F.forall(g["conditions"], _good_condition), F.lit(False))


def _good_rule(r: Column) -> Column:
    ids = r["source_passage_ids"]
    fine = (
        (r["rule_id"].isNull() | is_uuid(r["rule_id"])) & r["outcome_value"].isNotNull() & r["is_default"].isNotNull()
        & _whole(r["display_order"], 0, 1_000) & (r["label"] == F.trim(r["label"])) & F.length(r["label"]).between(1, 250)
        & (F.size(r["condition_groups"]) <= 20) & F.size(ids).between(1, 20) & F.forall(ids, is_uuid) & (F.size(F.array_distinct(ids)) == F.size(ids))
    )
    return F.coalesce(fine, F.lit(False))


def validate_rule_edits(df: DataFrame, body: str = "body") -> DataFrame:
    """First contract error of each proposed operation (JSON body), or null."""
    rows = df.withColumns({"_b": F.from_json(body, EDIT_BODY), "_keys": F.json_object_keys(body)})
    b = F.col("_b")
    action = b["action"]
    allowed = reduce(lambda acc, kv: acc.when(action == kv[0], F.array(*[F.lit(k) for k in kv[1]])), list(ACTION_KEYS.items())[1:],
                     F.when(action == "list", F.array(*[F.lit(k) for k in ACTION_KEYS["list"]])))
    named = lambda key: F.array_contains(F.col("_keys"), key)
    changes = action.isin("save", "confirm", "reject")
    one_set = action.isin("detail", "precheck", "create_revision", "simulate") | changes
    paged = action.isin("list", "history")
    rules = b["rules"]
    structured = F.forall(rules, lambda r: r["is_default"] == (F.size(r["condition_groups"]) == 0))
    note = F.trim(b["rejection_note"])
    unsure = F.coalesce(
        F.when(b["reason_code"] == "other", F.length(note).between(1, 500)).otherwise(~named("rejection_note")), F.lit(False))
    code = first_match(
        (action.isNull(), "invalid_request"),
        (allowed.isNull(), "invalid_action"),
        (F.size(F.array_except("_keys", allowed)) > 0, "unknown_field"),
        ((action == "simulate") & ~F.coalesce((F.length(F.trim(b["question"])) >= 1) & (F.length(b["question"]) <= 1_000), F.lit(False)), "invalid_question"),
        ((action == "save") & ~F.coalesce(F.size(rules).between(1, 100), F.lit(False)), "invalid_rules"),
        ((action == "save") & ~F.forall(rules, _good_rule), "invalid_rule"),
        ((action == "save") & ~F.coalesce(structured, F.lit(False)), "invalid_rule_structure"),
        ((action == "save") & ~F.forall(rules, lambda r: F.forall(r["condition_groups"], _good_group)), "invalid_condition_group"),
        ((action == "save") & ((F.size(F.filter(rules, lambda r: r["is_default"])) != 1)
         | (F.size(F.array_distinct(F.transform(rules, lambda r: r["display_order"]))) != F.size(rules))), "invalid_rule_structure"),
        ((action == "confirm") & ~F.coalesce(b["confirmation"], F.lit(False)), "confirmation_required"),
        ((action == "reject") & ~F.coalesce(b["reason_code"].isin(*REJECTIONS), F.lit(False)), "invalid_rejection_reason"),
        ((action == "reject") & ~unsure, "invalid_rejection_note"),
        ((action == "list") & named("document_id") & ~is_uuid(b["document_id"]), "invalid_document_id"),
        ((action == "list") & named("template_key") & ~F.coalesce(b["template_key"].rlike(f"^{KEY}\\z"), F.lit(False)), "invalid_template_key"),
        ((action == "list") & named("statuses") & ~F.coalesce((F.size(b["statuses"]) <= 6) & F.forall(b["statuses"], lambda s: s.isin(*STATUS_LABELS)), F.lit(False)), "invalid_statuses"),
        ((one_set | ((action == "history") & named("rule_set_id"))) & ~is_uuid(b["rule_set_id"]), "invalid_rule_set_id"),
        (paged & named("cursor") & ~F.coalesce(F.length(b["cursor"]) <= 500, F.lit(False)), "invalid_cursor"),
        (paged & named("limit") & ~_whole(b["limit"], 1, 100), "invalid_limit"),
        (changes & ~_whole(b["expected_revision_number"], 1, 9e15), "invalid_revision_number"),
        (changes & ~is_uuid(b["operation_id"]), "invalid_operation_id"),
    )
    return rows.withColumn("error_code", code).drop("_b", "_keys")


def validate_rule_context(sets: DataFrame) -> DataFrame:
    """Nested rule sets accepted by the typed contract: identifiers, bounds, no duplicates, binding."""
    t, rules = F.col("template"), F.col("rules")
    key = lambda c: F.coalesce(c.rlike(f"^{KEY}\\z"), F.lit(False))
    uuid = lambda c: F.coalesce(c.rlike(f"(?i)^{UUID}\\z"), F.lit(False))
    unique = lambda xs: F.size(F.array_distinct(xs)) == F.size(xs)

    def good_fact(f: Column) -> Column:
        bounds = f["minimum_number"].isNull() | f["maximum_number"].isNull() | (f["minimum_number"] <= f["maximum_number"])
        category = f["minimum_number"].isNull() & f["maximum_number"].isNull() & ~f["integer_only"] & (F.size(f["categories"]) > 0)
        return (
            key(f["fact_key"]) & key(f["extractor_key"]) & f["value_type"].isin("number", "category") & F.size(f["operators"]).between(1, 6)
            & F.forall(f["operators"], lambda o: o.isin(*OPERATOR_LABELS)) & unique(f["operators"]) & unique(f["categories"])
            & (F.size(f["categories"]) <= 100) & F.forall(f["categories"], key) & F.when(f["value_type"] == "number", bounds).otherwise(category)
        )

    def good_constraint(c: Column) -> Column:
        return key(c["constraint_key"]) & key(c["error_code"]) & c["comparator"].isin(*OPERATOR_LABELS) & (c["left_fact_key"] != c["right_fact_key"])

    def good_rule(r: Column) -> Column:
        groups = F.forall(r["groups"], lambda g: F.size(g).between(1, 20) & F.forall(g, _good_condition))
        return (
            uuid(r["rule_id"]) & r["outcome_value"].isNotNull() & r["is_default"].isNotNull() & F.length(r["label"]).between(1, 500)
            & (F.size(r["groups"]) <= 20) & F.size(r["sources"]).between(1, 20) & F.forall(r["sources"], uuid) & groups
        )

    keys = F.transform(t["facts"], lambda f: f["fact_key"])
    known = F.forall(t["constraints"], lambda c: F.array_contains(keys, c["left_fact_key"]) & F.array_contains(keys, c["right_fact_key"]))
    range_ok = t["result_minimum"].isNull() | t["result_maximum"].isNull() | (t["result_minimum"] <= t["result_maximum"])
    template_ok = (
        uuid(t["template_version_id"]) & key(t["template_key"]) & key(t["result_unit"]) & key(t["aggregation_strategy"]) & key(t["detector_key"])
        & key(t["renderer_key"]) & (t["result_value_type"] == "number") & range_ok & F.length(t["clarification"]).between(1, 1_000)
        & F.size(t["facts"]).between(1, 50) & (F.size(t["constraints"]) <= 50) & F.forall(t["facts"], good_fact)
        & F.forall(t["constraints"], good_constraint) & unique(keys) & known
    )
    binding = (
        (F.col("rule_key") == t["template_key"]) & (F.col("template_version_id") == t["template_version_id"])
        & (F.col("aggregation_strategy") == t["aggregation_strategy"]) & (F.col("result_unit") == t["result_unit"])
    )
    rules_ok = F.size(rules).between(1, 100) & F.forall(rules, good_rule)
    code = first_match(
        (~F.coalesce(uuid(F.col("rule_set_id")), F.lit(False)), "invalid_rule_set_id"),
        (~F.coalesce(template_ok, F.lit(False)), "invalid_template"),
        (~F.coalesce(binding, F.lit(False)), "invalid_binding"),
        (~F.coalesce(rules_ok, F.lit(False)), "invalid_rules"),
        default="accepted",
    )
    return sets.withColumn("contract_status", code)


def _joined(ops: DataFrame, sets: DataFrame) -> DataFrame:
    """Operations with their set; of several on one set only the first is judged against its revision."""
    firsts = ops.groupBy("rule_set_id").agg(F.min(F.struct("at", "operation_id")).alias("_first"))
    known = sets.select("rule_set_id", "institution_id", "document_id", "rule_key", "status", "revision_number", "replaces_rule_set_id")
    rows = ops.join(firsts, "rule_set_id").join(known, "rule_set_id", "left")
    return rows.withColumn("_later", F.struct("at", "operation_id") != F.col("_first")).drop("_first")


def apply_confirmations(ops: DataFrame, sets: DataFrame, docs: DataFrame, issues: DataFrame) -> DataFrame:
    """Outcome of confirmations (operation_id, rule_set_id, expected_revision, at).

    A set of a ready document is approved, one of an active document validated.
    Of several sets of one tenant and template the first sound one wins, and it
    may only take the place of the set it replaces.
    """
    docs = docs.select("document_id", "institution_id", F.col("status").alias("_doc"))
    unsound = issues.select("rule_set_id").distinct().withColumn("_unsound", F.lit(True))
    active = sets.where("status = 'validated'").groupBy("institution_id", "rule_key").agg(F.min("rule_set_id").alias("_active_id"))
    rows = _joined(ops, sets).join(docs, ["document_id", "institution_id"], "left").join(unsound, "rule_set_id", "left")
    rows = rows.join(active, ["institution_id", "rule_key"], "left")
    rivals = F.col("_active_id").isNotNull() & (F.col("_active_id") != F.col("rule_set_id"))
    early = first_match(
        (F.col("status").isNull(), "rule_set_not_found"),
        (F.col("status") != "proposed", "status_conflict"),
        (F.col("revision_number") != F.col("expected_revision"), "revision_conflict"),
        (F.col("_later"), "status_conflict"),
        (~F.coalesce(F.col("_doc").isin("ready", "active"), F.lit(False)), "document_not_eligible"),
        (F.coalesce("_unsound", F.lit(False)), "integrity_check_failed"),
        (F.col("_doc") == "ready", "approved"),
        (rivals & ~F.col("replaces_rule_set_id").eqNullSafe(F.col("_active_id")), "validated_rule_conflict"),
    )
    rows = rows.withColumn("_early", early)
    place = F.struct("at", "operation_id")
    winners = rows.where("_early is null").groupBy("institution_id", "rule_key").agg(F.min(place).alias("_won"))
    rows = rows.join(winners, ["institution_id", "rule_key"], "left")
    code = F.coalesce("_early", F.when(place == F.col("_won"), "validated").otherwise("validated_rule_conflict"))
    rows = rows.withColumn("status_code", code)
    done = F.col("status_code").isin("approved", "validated")
    return rows.withColumns(
        {
            "new_status": F.when(done, F.col("status_code")).otherwise(F.col("status")),
            "new_revision": F.when(done, F.col("revision_number") + 1).otherwise(F.col("revision_number")),
            "replaced_rule_set_id": F.when((F.col("status_code") == "validated") & rivals, F.col("_active_id")),
        }
    ).drop("_doc", "_unsound", "_active_id", "_early", "_won", "_later")


def apply_rejections(ops: DataFrame, sets: DataFrame) -> DataFrame:
    """Outcome of rejections (operation_id, rule_set_id, expected_revision, at, reason_code, note)."""
    note = F.trim("note")
    noted = F.when(F.col("reason_code") == "other", F.coalesce(F.length(note).between(1, 500), F.lit(False))).otherwise(F.col("note").isNull())
    code = first_match(
        (~F.coalesce(F.col("reason_code").isin(*REJECTIONS), F.lit(False)), "invalid_rejection_reason"),
        (~noted, "invalid_rejection_note"),
        (F.col("status").isNull(), "rule_set_not_found"),
        (~F.col("status").isin(*EDITABLE), "status_conflict"),
        (F.col("revision_number") != F.col("expected_revision"), "revision_conflict"),
        (F.col("_later"), "status_conflict"),
        default="rejected",
    )
    return _joined(ops, sets).withColumn("status_code", code).drop("_later")


def apply_corrections(ops: DataFrame, sets: DataFrame, passages: DataFrame, issues: DataFrame) -> DataFrame:
    """Outcome of saved corrections (operation_id, rule_set_id, expected_revision, at, rules as in an edit body).

    Every source must be a passage of the set's document. ``issues`` are those
    of the corrected rules; a set with issues needs attention, others are proposed again.
    """
    judged = _joined(ops, sets)
    cited = judged.select("operation_id", "document_id", "institution_id", F.explode("rules").alias("r")).select(
        "operation_id", "document_id", "institution_id", F.explode("r.source_passage_ids").alias("passage_id"))
    stray = cited.join(passages.select("passage_id", "document_id", "institution_id"), ["passage_id", "document_id", "institution_id"], "left_anti")
    stray = stray.select("operation_id").distinct().withColumn("_stray", F.lit(True))
    unsound = issues.select("rule_set_id").distinct().withColumn("_unsound", F.lit(True))
    rows = judged.join(stray, "operation_id", "left").join(unsound, "rule_set_id", "left")
    defaults = F.size(F.filter("rules", lambda r: F.coalesce(r["is_default"], F.lit(False))))
    code = first_match(
        (F.col("status").isNull(), "rule_set_not_found"),
        (F.col("status") == "validated", "validated_rule_immutable"),
        (~F.col("status").isin(*EDITABLE), "status_conflict"),
        (F.col("revision_number") != F.col("expected_revision"), "revision_conflict"),
        (F.col("_later"), "revision_conflict"),
        (F.coalesce("_stray", F.lit(False)) | (defaults != 1), "invalid_rule_structure"),
        default="saved",
    )
    saved = F.col("status_code") == "saved"
    return rows.withColumn("status_code", code).withColumns(
        {
            "new_status": F.when(saved, F.when(F.coalesce("_unsound", F.lit(False)), "needs_attention").otherwise("proposed")).otherwise(F.col("status")),
            "new_revision": F.when(saved, F.col("revision_number") + 1).otherwise(F.col("revision_number")),
            "approval_cancelled": saved & (F.col("status") == "approved"),
        }
    ).drop("_stray", "_unsound", "_later")


def cascade_documents(changes: DataFrame, sets: DataFrame, issues: DataFrame) -> DataFrame:
    """Effect of document status changes on their rule sets, one row per set touched.

    changes: document_id, institution_id, old_status, new_status. Leaving ready
    or active invalidates open and validated sets; activation validates approved
    ones unless they are unsound or another set of the template is in force.
    """
    moved = changes.where(~F.col("old_status").eqNullSafe(F.col("new_status")))
    rows = moved.join(sets, ["document_id", "institution_id"])
    unsound = issues.select("rule_set_id").distinct().withColumn("_unsound", F.lit(True))
    in_force = sets.where("status = 'validated'").groupBy("institution_id", "rule_key").agg(F.count("*").alias("_in_force"))
    rows = rows.join(unsound, "rule_set_id", "left").join(in_force, ["institution_id", "rule_key"], "left")
    first = rows.where("new_status = 'active' and status = 'approved'").groupBy("institution_id", "rule_key").agg(F.min("rule_set_id").alias("_first"))
    rows = rows.join(first, ["institution_id", "rule_key"], "left")
    leaves = ~F.col("new_status").isin("ready", "active") & F.col("status").isin(*OPEN_RULES)
    enters = (F.col("new_status") == "active") & (F.col("status") == "approved")
    rival = (F.coalesce("_in_force", F.lit(0)) > 0) | (F.col("rule_set_id") != F.col("_first"))
    effect = first_match(
        (leaves, "invalidated"),
        (enters & F.coalesce("_unsound", F.lit(False)), "rule_activation_integrity_failed"),
        (enters & rival, "rule_activation_conflict"),
        (enters, "validated"),
    )
    out = rows.withColumn("effect", effect).where("effect is not null")
    done = F.col("effect").isin("invalidated", "validated")
    return out.withColumns(
        {
            "event_type": F.when(done, F.concat(F.lit("rule_"), "effect")),
            "resulting_status": F.when(done, F.col("effect")).otherwise(F.col("status")),
            "reason_code": F.when(leaves, "document_not_eligible"),
        }
    ).drop("_unsound", "_in_force", "_first")


def cascade_child_edits(edits: DataFrame, sets: DataFrame) -> DataFrame:
    """Effect of changing a rule, group, condition or source of a set."""
    code = first_match(
        (F.col("status") == "validated", "validated_rule_immutable"),
        (F.col("status").isin("rejected", "invalidated"), "rule_set_immutable"),
        (F.col("status") == "approved", "needs_attention"),
        default="unchanged",
    )
    return edits.join(sets.select("rule_set_id", "status"), "rule_set_id").withColumn("effect", code)


def clone_revisions(requests: DataFrame, sets: DataFrame, children: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Open a revision of each requested validated set and copy everything below it.

    ``children`` maps a table name to (table, id columns to renew). New ids are
    digests of the request and the old id, so a recomputed task yields the same ones.
    """
    opened = sets.where(F.col("status").isin(*EDITABLE) & F.col("parent_rule_set_id").isNotNull()).groupBy("parent_rule_set_id").agg(F.min("rule_set_id").alias("_open"))
    rows = requests.select("operation_id", "rule_set_id").join(sets, "rule_set_id", "left").join(
        opened.withColumnRenamed("parent_rule_set_id", "rule_set_id"), "rule_set_id", "left")
    firsts = requests.groupBy("rule_set_id").agg(F.min("operation_id").alias("_first"))
    rows = rows.join(firsts, "rule_set_id")
    code = first_match(
        (F.col("status").isNull(), "rule_set_not_found"), (F.col("status") != "validated", "status_conflict"),
        (F.col("_open").isNotNull() | (F.col("operation_id") != F.col("_first")), "revision_already_open"), default="revision_created")
    fresh = uuid_from(F.lit("rule_set_id"), F.col("_first"), F.col("rule_set_id"))
    results = rows.select("operation_id", "rule_set_id", code.alias("status_code"),
                          F.when(F.col("status") == "validated", F.coalesce(F.col("_open").cast("string"), fresh)).alias("revision_id"))
    made = results.where("status_code = 'revision_created'").select("operation_id", "rule_set_id", "revision_id")
    copies = {}
    for name, (table, ids) in children.items():
        below = table.join(made, "rule_set_id")
        renewed = {c: uuid_from(F.lit(c), F.col("operation_id"), F.col(c)) for c in ids}
        copies[name] = below.withColumns({**renewed, "rule_set_id": F.col("revision_id")}).drop("operation_id", "revision_id")
    return results, copies


def audit_events(changes: DataFrame, event_type: Column, now: Column) -> DataFrame:
    """Audit rows of applied operations, ready for the append-only sink."""
    return changes.select("rule_set_id", "institution_id", "document_id", event_type.alias("event_type"), F.col("status").alias("old_status"),
                          "new_status", now.alias("created_at"), F.to_date(now).alias("event_date"))


def list_rule_sets(
    sets: DataFrame, docs: DataFrame, document_id: object = None, rule_key: str | None = None, statuses: tuple[str, ...] | None = None,
    action_required: bool | None = None,
) -> DataFrame:
    """Rule sets with their document and required action, narrowed by whatever is given; page with the generic helper.

    Filters reach the scan of the rule sets, before documents are joined. ``action_required`` asks for sets that wait for a person, or
    for those that do not.
    """
    asked = filter_optional(sets, document_id=document_id, rule_key=rule_key, status=statuses)
    if action_required is not None:
        asked = asked.where(F.coalesce(F.col("status").isin(*STATUS_ACTIONS), F.lit(False)) == F.lit(action_required))
    titles = docs.select("document_id", "institution_id", F.col("title").alias("document_title"), F.col("status").alias("document_status"))
    return with_labels(with_rule_action(asked.join(titles, ["document_id", "institution_id"])))


def audit_history(
    events: DataFrame, users: DataFrame, rule_set_id: object = None, document_id: object = None, event_types: tuple[str, ...] | None = None,
    since: Column | None = None,
) -> DataFrame:
    """Audit events with the name of who acted, narrowed by whatever is given; system events have no name."""
    asked = filter_optional(events, rule_set_id=rule_set_id, document_id=document_id, event_type=event_types)
    if since is not None:
        asked = asked.where(F.col("created_at") >= since)
    names = users.select(F.col("user_id").alias("actor_id"), F.col("display_name").alias("actor_name"))
    return asked.join(names, "actor_id", "left")


def registry_diff(manifest: DataFrame, code: DataFrame) -> DataFrame:
    """Registry entries present on one side only."""
    keys = ["key_type", "runtime_key"]
    side = lambda a, b, name: a.select(*keys).exceptAll(b.select(*keys)).withColumn("only_in", F.lit(name))
    return side(manifest, code, "manifest").unionByName(side(code, manifest, "code"))
