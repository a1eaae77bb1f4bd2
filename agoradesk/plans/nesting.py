"""Nested rule sets and the template catalogue: every supplier holds a rule set of its order lines and a template version."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.operators import nested
from agoradesk.session import staged
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


def lines(spark, sf):
    rule = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_suppkey", "l_orderkey", "l_linenumber")))
    return read_table(spark, sf, "lineitem").withColumns({
        "rule_id": rule, "condition_group_id": F.concat_ws("-", rule, "l_returnflag"),
        "template_version_id": F.concat(F.lit("v"), F.col("l_suppkey").cast("string")), "fact_key": F.concat(F.lit("f"), F.col("l_linenumber").cast("string")),
    })


def templates(spark, sf):
    versions = read_table(spark, sf, "supplier").select(F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("template_version_id"), F.lit("days").alias("result_unit"))
    # A template holds few kinds of lines, so lines are read once into one row per kind.
    kinds = read_table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").agg(F.min("l_quantity").alias("lowest"), F.max("l_quantity").alias("highest"))
    line = staged(kinds, "kinds").withColumns({
        "template_version_id": F.concat(F.lit("v"), F.col("l_suppkey").cast("string")), "fact_key": F.concat(F.lit("f"), F.col("l_linenumber").cast("string"))})
    facts = line.groupBy("template_version_id", "fact_key").agg(
        (-F.max("l_linenumber")).alias("display_order"), F.lit("number").alias("value_type"), F.lit("digits").alias("extractor_key"),
        F.min("lowest").cast("long").alias("minimum_number"), F.max("highest").cast("long").alias("maximum_number"), F.lit(True).alias("integer_only"))
    operators = line.where("l_linenumber <> 7").select("template_version_id", "fact_key", F.when(F.col("l_linestatus") == "O", ">=").otherwise("<").alias("comparator")).distinct()
    categories = line.where("l_linenumber <> 6").select("template_version_id", "fact_key", F.lit(0).alias("display_order"), F.col("l_returnflag").alias("value_key"), F.lower("l_returnflag").alias("label")).distinct()
    constraints = line.where("l_linenumber = 4").select("template_version_id", F.col("l_returnflag").alias("constraint_key"), F.lit("f1").alias("left_fact_key"),
                                                        F.lit("<=").alias("comparator"), F.lit("f2").alias("right_fact_key"), F.lit("order").alias("error_code")).distinct()
    return nested.template_documents(versions, facts, operators, categories, constraints)


LINES_SQL = """with line as (select *, l_suppkey || '-' || l_orderkey || '-' || l_linenumber rule_id, l_suppkey || '-' || l_orderkey || '-' || l_linenumber || '-' || l_returnflag gid,
 'v' || l_suppkey tv, 'f' || l_linenumber fact_key from lineitem)"""
TEMPLATE_SQL = """,
 ops as (select tv, fact_key, list(c order by c) x from (select distinct tv, fact_key, case when l_linestatus = 'O' then '>=' else '<' end c from line where l_linenumber <> 7) group by all),
 cats as (select tv, fact_key, list({value_key: k, label: lower(k)} order by k) x from (select distinct tv, fact_key, l_returnflag k from line where l_linenumber <> 6) group by all),
 facts as (select tv, fact_key, max(l_linenumber) n, cast(min(l_quantity) as bigint) lo, cast(max(l_quantity) as bigint) hi from line group by all),
 tfacts as (select tv, list({fact_key: f.fact_key, value_type: 'number', extractor_key: 'digits', minimum_number: lo, maximum_number: hi, integer_only: true,
   allowed_operators: coalesce(o.x, []), category_values: coalesce(c.x, [])} order by -n, f.fact_key) x
   from facts f left join ops o using (tv, fact_key) left join cats c using (tv, fact_key) group by tv),
 cons as (select tv, list({constraint_key: k, left_fact_key: 'f1', comparator: '<=', right_fact_key: 'f2', error_code: 'order'} order by k) x
   from (select distinct tv, l_returnflag k from line where l_linenumber = 4) group by tv)"""


@register("rule_set_documents", LINES_SQL + TEMPLATE_SQL + """,
 cond as (select gid, list({fact_key: fact_key, fact_value_type: kind, comparator: cmp, number_value: n, category_value: cat} order by fact_key, cmp, n nulls last, cat nulls last) x from (
   select gid, fact_key, 'number' kind, '>=' cmp, cast(max(l_quantity) as bigint) n, null::varchar cat from line group by all
   union all select distinct gid, fact_key, 'category', '>=', null, l_returnflag from line where l_linenumber % 2 = 0) group by gid),
 grp as (select rule_id, list({condition_group_id: gid, conditions: c.x} order by gid) x from (select distinct rule_id, gid from line where l_linenumber <> 1) left join cond c using (gid) group by rule_id),
 src as (select rule_id, list(l_partkey order by l_partkey) x from (select distinct rule_id, l_partkey from line where l_linenumber <> 5) group by rule_id),
 rule as (select l_suppkey, rule_id, max(l_linenumber) n, cast(sum(l_quantity) as bigint) q, min(l_returnflag) label from line group by all),
 rules as (select l_suppkey, to_json(list({rule_id: r.rule_id, outcome_value: q, is_default: n = 1, label: label, condition_groups: coalesce(g.x, []), source_passage_ids: s.x} order by n, r.rule_id)) x
   from rule r left join grp g using (rule_id) left join src s using (rule_id) group by l_suppkey)
 select s_suppkey rule_set_id, sha256(r.x::varchar) rules_sha256,
  to_json({template_version_id: 'v' || s_suppkey, result_unit: 'days', facts: coalesce(t.x, []), fact_constraints: coalesce(c.x, [])})::varchar as template
 from supplier left join rules r on r.l_suppkey = s_suppkey left join tfacts t on t.tv = 'v' || s_suppkey left join cons c on c.tv = 'v' || s_suppkey""")
def rule_set_documents(spark, sf):
    line = lines(spark, sf)
    sets = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("rule_set_id"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("template_version_id"))
    # Rows are dealt by the key of the list they end in before they are made distinct: nearly every line is a rule of its own, so
    # nothing is saved by counting lines together before they travel.
    rules = line.select("rule_id", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag").repartition("rule_id").groupBy(F.col("l_suppkey").alias("rule_set_id"), "rule_id").agg(
        F.max("l_linenumber").alias("display_order"), F.sum("l_quantity").cast("long").alias("outcome_value"), (F.max("l_linenumber") == 1).alias("is_default"), F.min("l_returnflag").alias("label"))
    groups = line.where("l_linenumber <> 1").select("rule_id", "condition_group_id", F.lit(0).alias("display_order")).repartition("condition_group_id").distinct()
    number = F.struct(F.lit("number").alias("fact_value_type"), F.col("l_quantity").alias("number_value"), F.lit(None).cast("string").alias("category_value"))
    word = F.struct(F.lit("category").alias("fact_value_type"), F.lit(None).cast("double").alias("number_value"), F.col("l_returnflag").alias("category_value"))
    conditions = line.select("condition_group_id", "fact_key", F.inline(F.when(F.col("l_linenumber") % 2 == 0, F.array(number, word)).otherwise(F.array(number))))
    conditions = conditions.repartition("condition_group_id").groupBy("condition_group_id", "fact_key", "fact_value_type", "category_value").agg(F.max("number_value").cast("long").alias("number_value"))
    sources = line.where("l_linenumber <> 5").select("rule_id", F.col("l_partkey").alias("passage_id")).repartition("rule_id").distinct()
    out = nested.rule_set_documents(sets, rules, groups, conditions.withColumn("comparator", F.lit(">=")), sources, templates(spark, sf))
    whole = {"ignoreNullFields": "false"}
    return out.select("rule_set_id", F.sha2(F.to_json("rules", whole), 256).alias("rules_sha256"), F.to_json("template", whole).alias("template"))


@register("template_catalog", """with v as (select l_suppkey, list({template_version_id: l_suppkey || '/' || l_linenumber, version_number: l_linenumber, status: case when l_linenumber = n then 'published' else 'retired' end,
   published_at: p, retired_at: case when l_linenumber <> n then q end} order by l_linenumber) x
  from (select l_suppkey, l_linenumber, strftime(min(l_shipdate), '%Y-%m-%d') p, strftime(max(l_shipdate), '%Y-%m-%d') q, max(l_linenumber) over (partition by l_suppkey) n from lineitem group by l_suppkey, l_linenumber) group by l_suppkey)
 select s_suppkey template_key, s_name as name, to_json(coalesce(x, []))::varchar as versions from supplier left join v on l_suppkey = s_suppkey""")
def template_catalog(spark, sf):
    own = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("template_key"), F.col("s_name").alias("name"))
    line = read_table(spark, sf, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.min("l_shipdate").alias("p"), F.max("l_shipdate").alias("q"))
    newest = line.groupBy("l_suppkey").agg(F.max("l_linenumber").alias("n"))
    current = F.col("l_linenumber") == F.col("n")
    versions = line.join(newest, "l_suppkey").select(
        F.col("l_suppkey").alias("template_key"), F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("template_version_id"),
        F.col("l_linenumber").alias("version_number"), F.when(current, "published").otherwise("retired").alias("status"),
        F.date_format("p", "yyyy-MM-dd").alias("published_at"), F.when(~current, F.date_format("q", "yyyy-MM-dd")).alias("retired_at"))
    return nested.template_catalog(own, versions).select("template_key", "name", F.to_json("versions", {"ignoreNullFields": "false"}).alias("versions"))
