import datetime as dt

from pyspark.sql import functions as F

from agoradesk.operators import events as ev
from agoradesk.operators import governance as gv
from agoradesk.operators import integrity as ig
from agoradesk.operators import onboarding as ob
from agoradesk.operators import rules as rl

T0 = dt.datetime(2024, 1, 1)


def test_three_days_on_the_wrong_category_is_found(spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    sets = d([(1, 1, "h", "tv", "days")], "rule_set_id int, document_id int, institution_id string, template_version_id string, result_unit string")
    docs = d([(1, "h", "ready")], "document_id int, institution_id string, status string")
    templates = d([("tv", "published", "exceptional_leave_intent_v1", "exceptional_leave_answer_fr_v1", rl.STRATEGY)],
                  "template_version_id string, status string, detector_key string, renderer_key string, aggregation_strategy string")
    facts = d([("tv", "leave_reason_fr_v1")], "template_version_id string, extractor_key string")
    registry = d([(t, k) for t, ks in rl.REGISTRY.items() for k in ks], "key_type string, runtime_key string")
    rules = d([(10, 1, 1.0, True), (11, 1, 3.0, False), (12, 1, 3.0, False)], "rule_id int, rule_set_id int, outcome_value double, is_default boolean")
    groups = d([(11, 11), (12, 12)], "group_id int, rule_id int")
    conds = d([(11, 11, 1, "tv", "leave_reason", None, "marriage"), (12, 12, 1, "tv", "leave_reason", None, "death_first_degree")],
              "group_id int, rule_id int, rule_set_id int, template_version_id string, fact_key string, number_value double, category_value string")
    passages = d([(100, 1, "h", "Déménagement : 1 jour."), (101, 1, "h", "Mariage ou partenariat enregistré : 3 jours.")], "passage_id int, document_id int, institution_id string, content string"
                 ).withColumn("content_sha256", F.sha2("content", 256))
    sources = d([(10, 1, 100), (11, 1, 101), (12, 1, 101)], "rule_id int, rule_set_id int, passage_id int").join(passages.drop("content"), "passage_id")
    none = d([], "template_version_id string, left_fact_key string, comparator string, right_fact_key string")
    found = ig.inspect_integrity(sets, docs, templates, facts, registry, rules, groups, conds, sources, passages, ig.signature_table(spark, "tv"), none).collect()
    assert [(r.rule_id, r.code) for r in found] == [(12, "categorical_source_mismatch")]


def test_every_integrity_code_of_one_pass(spark):
    d = lambda rows, schema: spark.createDataFrame(rows, schema)
    sets = d([(1, 1, "h", "tv", "days"), (2, 2, "h", "old", "hours"), (3, 1, "h", "tv", "hours"), (4, 1, "g", "none", "days")],
             "rule_set_id int, document_id int, institution_id string, template_version_id string, result_unit string")
    docs = d([(1, "h", "ready"), (2, "h", "inactive")], "document_id int, institution_id string, status string")
    templates = d([("tv", "published", "annual_leave_intent_v1", "annual_leave_answer_fr_v1", rl.STRATEGY), ("old", "draft", "annual_leave_intent_v1", "other", rl.STRATEGY)],
                  "template_version_id string, status string, detector_key string, renderer_key string, aggregation_strategy string")
    facts = d([("tv", "age_years_fr_v1")], "template_version_id string, extractor_key string")
    registry = d([(t, k) for t, ks in rl.REGISTRY.items() for k in ks], "key_type string, runtime_key string")
    rules = d([(10, 1, 2.5, True), (11, 1, 30.0, False), (12, 1, 7.0, False), (30, 3, 2.5, True), (31, 3, 4.0, True)],
              "rule_id int, rule_set_id int, outcome_value double, is_default boolean")
    groups = d([(110, 11), (111, 11), (120, 12)], "group_id int, rule_id int")
    conds = d([(110, 11, 1, "tv", "age_years", 20.0, None), (110, 11, 1, "tv", "service_years", 30.0, None), (120, 12, 1, "tv", "age_years", 50.0, None)],
              "group_id int, rule_id int, rule_set_id int, template_version_id string, fact_key string, number_value double, category_value string")
    passages = d([(100, 1, "h", "Forfait de 2,5 jours, puis 130 jours."), (101, 1, "h", "Sept : 7 heures"), (102, 1, "h", "12.5")],
                 "passage_id int, document_id int, institution_id string, content string").withColumn("content_sha256", F.sha2("content", 256))
    cited = d([(10, 1, 100), (11, 1, 100), (12, 1, 101), (30, 3, 102)], "rule_id int, rule_set_id int, passage_id int")
    sources = cited.join(passages.drop("content"), "passage_id").withColumn("content_sha256", F.when(F.col("rule_id") == 11, "old").otherwise(F.col("content_sha256")))
    limit = d([("tv", "service_years", "<=", "age_years")], "template_version_id string, left_fact_key string, comparator string, right_fact_key string")
    inputs = (sets, docs, templates, facts, registry, rules, groups, conds, sources, passages, ig.signature_table(spark, "other"), limit)
    want = {
        (1, None, "template_fact_constraint_failed"), (1, 11, "invalid_rule_structure"), (1, 11, "source_changed"), (1, 11, "value_or_unit_not_in_source"),
        (1, 12, "value_or_unit_not_in_source"), (2, None, "document_not_eligible"), (2, None, "template_not_executable"), (2, None, "runtime_registry_mismatch"),
        (2, None, "invalid_default_rule_count"), (3, None, "invalid_default_rule_count"), (3, 30, "value_or_unit_not_in_source"), (3, 31, "missing_rule_sources"),
        (4, None, "document_not_eligible"), (4, None, "template_not_executable"), (4, None, "invalid_default_rule_count"),
    }
    found = [tuple(r) for r in ig.inspect_integrity(*inputs).collect()]
    assert set(found) == want and len(found) == len(want)
    asked = d([(2,), (99,), (2,)], "rule_set_id int")
    some = {tuple(r) for r in ig.inspect_integrity(*inputs, asked=asked).collect()}
    assert some == {w for w in want if w[0] == 2} | {(99, None, "rule_set_not_found")}


def test_outcome_text(spark):
    got = spark.createDataFrame([(30.0,), (2.5,), (0.0,), (100.0,)], "v double").select(ig.outcome_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in got] == ["30", "2.5", "0", "100"] or [r.t for r in got] == ["30", "2.5", "", "100"]


def test_clones_are_repeatable_and_keep_lineage(spark):
    sets = spark.createDataFrame([(1, "validated", None), (2, "proposed", None)], "rule_set_id int, status string, parent_rule_set_id int")
    rules = spark.createDataFrame([(5, 1), (6, 1), (7, 2)], "rule_id int, rule_set_id int")
    groups = spark.createDataFrame([(50, 5, 1)], "group_id int, rule_id int, rule_set_id int")
    ask = spark.createDataFrame([(100, 1), (101, 1), (102, 2), (103, 9)], "operation_id int, rule_set_id int")
    results, copies = gv.clone_revisions(ask, sets, {"rules": (rules, ["rule_id"]), "groups": (groups, ["rule_id", "group_id"])})
    codes = {r.operation_id: (r.status_code, r.revision_id) for r in results.collect()}
    assert [codes[i][0] for i in (100, 101, 102, 103)] == ["revision_created", "revision_already_open", "status_conflict", "rule_set_not_found"]
    assert codes[100][1] == codes[101][1]
    new_rules = {r.rule_id for r in copies["rules"].collect()}
    assert len(new_rules) == 2 and {r.rule_id for r in copies["groups"].collect()} < new_rules
    assert new_rules == {r.rule_id for r in copies["rules"].collect()}


def test_editorial_history(spark):
    path = ["draft", "needs_review", "validated", "published", "archived", "draft"]
    rows = [(1, i, s, "t") for i, s in enumerate(path)] + [(2, 0, "published", "t"), (3, 0, "draft", "t"), (3, 1, "validated", "t"), (4, 0, "draft", "a"), (4, 1, "needs_review", "b"),
            (4, 2, "validated", "b"), (4, 3, "published", "c")]
    h = spark.createDataFrame(rows, "id int, v int, status string, title string")
    bad = {(r.id, r.v) for r in ev.illegal_transitions(h, ["id"], ["v"], F.floor(F.col("v") / 2)).collect()}
    assert bad == {(1, 5), (2, 0), (3, 1)}
    broken = {(r.id, r.v) for r in ev.immutable_changes(h, ["id"], ["v"], F.floor(F.col("v") / 2)).collect()}
    assert broken == {(1, 5), (4, 3)}


def test_pins_and_requests(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    pins = spark.createDataFrame([("c1", 1, at(0), "pin", 7, "1j"), ("c1", 2, at(1), "delete", 8, None), ("c2", 3, at(0), "pin", 9, "1j"), ("c2", 4, at(1), "delete", 9, None),
                                  ("c3", 5, at(0), "pin", 1, "1h"), ("c4", 6, at(0), "pin", 1, "3j"), ("c4", 7, at(1), "unpin", None, None)],
                                 "c string, id int, ts timestamp, action string, message_id int, duration string")
    live = {r.c: r.pinned for r in ev.pin_state(pins, ["c"], "ts", "id", F.lit(at(2))).collect()}
    assert live == {"c1": True, "c2": False, "c3": False, "c4": False}
    asked = spark.createDataFrame([(1, "d", at(0)), (2, "d", at(5)), (3, "e", at(0)), (4, "f", at(40)), (5, "g", at(0)), (6, "g", at(30))], "request_id int, device_id string, created_at timestamp")
    done = spark.createDataFrame([(2, "approved", at(6)), (3, "approved", at(30))], "request_id int, decision string, decided_at timestamp")
    got = {r.request_id: r.status for r in ev.request_state(asked, done, F.lit(at(48))).collect()}
    assert got == {1: "cancelled", 2: "approved", 3: "expired", 4: "pending", 5: "expired", 6: "pending"}


def test_onboarding_isolation_and_masking(spark):
    rows = [("h1", "published", True, None), ("h1", "draft", True, None), ("h1", "published", False, None), ("h1", "published", True, "intern"), ("h2", "published", True, "other")]
    df = spark.createDataFrame(rows, "tenant string, status string, active boolean, audience string")
    assert ob.published(df, "intern").groupBy("tenant").count().collect() == [("h1", 2)]
    c = spark.createDataFrame([("1", "a", True, False)], "phone string, email string, phone_validated boolean, email_validated boolean")
    assert tuple(ob.mask_contacts(c).select("phone", "email").first()) == ("1", None)
    scope = "tenant string, item string, service_id int, job_id int, unit_id int"
    items = spark.createDataFrame([("h1", "all", None, None, None), ("h1", "s1", 1, None, None), ("h1", "s1j2", 1, 2, None), ("h1", "u3", None, None, 3), ("h2", "s1", 1, None, None)], scope)
    people = spark.createDataFrame([("h1", "p", 1, 2, None)], "tenant string, p string, service_id int, job_id int, unit_id int")
    assert sorted(r.item for r in ob.items_for_profiles(items, people, "tenant").collect()) == ["all", "s1", "s1j2"]


def test_sets_of_a_request_without_comparing_all_pairs(spark):
    import itertools

    places = list(itertools.product((1, 2, None), ("a", "b", None)))
    sets = [(s, i, i, k, "validated" if n % 7 else "proposed") for n, (s, (i, k)) in enumerate(itertools.product((1, 2, 3, None), places))] + [(9, 1, 1, "a", "validated")] * 2
    requests = [(r, i, t, [r % 3, 1, 1] if r else None) for r, (i, t) in enumerate(places)] + [(2, 1, "a", [0]), (None, 1, "a", [1]), (None, 2, "b", [2]), (50, 1, "a", [0, 2]), (50, 1, "a", [0, 2])]
    sources = [(p, i, s) for p in range(3) for i in (1, 2) for s in (1, 3, 9, None) if (p + i) % 2] * 2
    ds = spark.createDataFrame(sets, "rule_set_id long, document_id long, institution_id long, rule_key string, status string")
    dr = spark.createDataFrame(requests, "request_id long, institution_id long, template_key string, passage_ids array<long>")
    dp = spark.createDataFrame(sources, "passage_id long, institution_id long, rule_set_id long")
    docs = spark.createDataFrame([(1, 1, "active"), (2, 2, "active")], "document_id long, institution_id long, status string")
    usable = [(s, i, k) for s, _, i, k, status in sets if status == "validated" and i]
    wanted = {(r, s) for r, i, t, _ in requests for s, j, k in usable if i == j and t and t == k}
    wanted |= {(r, s) for r, i, _, ps in requests for p, j, s in sources if p in (ps or []) and i == j and s and any((s, i) == u[:2] for u in usable)}
    out = ig.rule_context(ds, docs, dp, dr)
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == wanted
    # Nothing makes all pairs of requests and sets of a template distinct.
    assert out._jdf.queryExecution().analyzed().nodeName() == "Union"
