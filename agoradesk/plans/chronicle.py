"""State at a moment: production limits, reply targets, reactions, version lifecycles, revision chains, overlaps, many needles, percentiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.functions.columns import epoch_bucket
from agoradesk.operators import chat, intervals, limits, needles, reporting, revisions
from agoradesk.operators import events as ev
from agoradesk.plans import relational, roles
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


ORDER = ["ts", "event_id", "part", "supplier"]
# Every shipped line is an attempt; the months of the years are hours, so that hours are full enough for the limits to bite.
# The IP of a request stands for a building, that of an activation for a line.
TRIES_SQL = """tries as (select l_orderkey * 10 + l_linenumber event_id, timestamp '2024-01-01' + to_hours(cast(year(l_shipdate) * 12 + month(l_shipdate) - 23900 as integer))
  + to_seconds(l_orderkey % 3600) ts, l_partkey % 200 device, l_suppkey % {ips} ip, l_partkey % 9 token, l_linestatus institution, l_partkey part, l_suppkey supplier from lineitem)"""


def tries(spark, sf, ips=20):
    row = read_table(spark, sf, "lineitem")
    hours = (F.year("l_shipdate") * 12 + F.month("l_shipdate") - 23900).cast("int")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=hours, secs=(F.col("l_orderkey") % 3600).cast("decimal(18,6)"))
    return row.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), at.alias("ts"), (F.col("l_partkey") % 200).alias("device"),
        (F.col("l_suppkey") % ips).alias("ip"), (F.col("l_partkey") % 9).alias("token"), F.col("l_linestatus").alias("institution"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))


def cascade_sql(window: str, scopes, ips: int) -> str:
    inner = f"select *, {window} w, cast(null as varchar) rejected_by from tries"
    for name, limit in scopes:
        inner = f"""select * exclude (rejected_by, n), n {name}_count, coalesce(rejected_by, case when n > {limit} then '{name}' end) rejected_by from
          (select *, case when rejected_by is null then row_number() over (partition by {name}, w, rejected_by is null order by {', '.join(ORDER)}) end n from ({inner}))"""
    return f"with {TRIES_SQL.format(ips=ips)} select event_id, {', '.join(f'{name}_count' for name, _ in scopes)}, rejected_by from ({inner})"


def limited(spark, sf, scopes, window, ips):
    out = limits.tumbling_limits(tries(spark, sf, ips), [(name, name, limit) for name, limit in scopes], window, ORDER)
    return out.select("event_id", *[f"{name}_count" for name, _ in scopes], "rejected_by")


@register("production_request_limits", cascade_sql("date_trunc('hour', ts)", limits.REQUEST_SCOPES, 20))
def production_request_limits(spark, sf):
    return limited(spark, sf, limits.REQUEST_SCOPES, ev.hour_of("ts"), 20)


@register("production_activation_limits", cascade_sql("time_bucket(interval 10 minute, ts)", limits.ACTIVATION_SCOPES, 4))
def production_activation_limits(spark, sf):
    return limited(spark, sf, limits.ACTIVATION_SCOPES, epoch_bucket(F.col("ts"), 600), 4)


@register("production_upload_limit", "with " + TRIES_SQL.format(ips=20) + """ select event_id, n <= 20 accepted, cast(least(n, 20) as integer) counter from (select event_id,
 row_number() over (partition by institution, date_trunc('hour', ts) order by """ + ", ".join(ORDER) + ") n from tries)")
def production_upload_limit(spark, sf):
    out = limits.saturating_limit(tries(spark, sf), "institution", ev.hour_of("ts"), ORDER)
    return out.select("event_id", "accepted", "counter")


DELETED_SQL = """size as (select max(event_id) + 1 n from events),
 gone as (select (event_id * 3) % n message_id, ts deleted_at from events, size where event_type = 'error')"""


def deletions(spark, sf, e):
    return e.where("event_type = 'error'").select((F.col("event_id") * 3 % roles.span(spark, sf, "events", "event_id")).alias("message_id"), F.col("ts").alias("deleted_at"))


@register("reply_targets", "with " + DELETED_SQL + """, m as (select event_id message_id, ts, user_id % 2 institution_id, event_id % 2 channel_id,
  case when event_id % 4 <> 0 then (event_id * 7) % n end reply_to from events, size)
select m.message_id, m.reply_to is null or (t.ts <= m.ts and not exists (select 1 from gone g where g.message_id = m.reply_to and g.deleted_at <= m.ts)) reply_ok
from m left join m t on t.message_id = m.reply_to and t.institution_id = m.institution_id and t.channel_id = m.channel_id where m.reply_to is null or t.message_id is not null
union all select m.message_id, false from m anti join (select message_id reply_to, institution_id, channel_id from m) t using (reply_to, institution_id, channel_id) where m.reply_to is not null""")
def reply_targets(spark, sf):
    e = roles.events(spark, sf)
    n = F.col("event_id")
    msgs = e.select(
        n.alias("message_id"), "ts", (F.col("user_id") % 2).alias("institution_id"), (n % 2).alias("channel_id"),
        F.when(n % 4 != 0, n * 7 % roles.span(spark, sf, "events", "event_id")).alias("reply_to"))
    sent = msgs.select("message_id", "institution_id", "channel_id", F.col("ts").alias("created_at"))
    return chat.reply_targets(msgs, sent, deletions(spark, sf, e), "ts").select("message_id", "reply_ok")


OUTCOME_SQL = """with recursive """ + DELETED_SQL + """,
 raw as (select event_id, timestamp '2024-01-01' + to_seconds((event_id // 10) % 600) ts, user_id % 10 who, (event_id * 11) % (n // 30) message_id, case when event_id % 2 = 0 then '👍' else '😂' end emoji from events, size),
 lost as (select message_id, timestamp '2024-01-01' + to_seconds(cast(floor(epoch(deleted_at)) as bigint) % 600) deleted_at from gone),
 flagged as (select *, exists (select 1 from lost l where l.message_id = raw.message_id and l.deleted_at <= raw.ts) late from raw),
 e as (select *, epoch_us(ts) tm, row_number() over (partition by who order by ts, event_id) rn from flagged where not late),
 walk as (select who, 0::bigint rn, null::bigint event_id, false ok, []::bigint[] acc from (select distinct who from e)
  union all select who, rn, event_id, ok, case when ok then list_append(recent, tm) else recent end from (select e.*, recent, len(list_filter(recent, lambda a: a >= e.tm - 60000000)) < 60 and len(recent) < 500 ok
   from (select e.*, list_filter(w.acc, lambda a: a >= e.tm - 3600000000) recent from walk w join e on e.who = w.who and e.rn = w.rn + 1) e)),
 told as (select event_id, 'message_deleted' status_code from flagged where late union all select event_id, 'rate_limited' from walk where rn > 0 and not ok
  union all select event_id, case when row_number() over (partition by message_id, who, emoji order by ts, event_id) % 2 = 1 then 'added' else 'removed' end
   from e where event_id in (select event_id from walk where ok))"""


def reactions(spark, sf):
    e = roles.events(spark, sf)
    n = F.col("event_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda seconds: start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    raw = e.select(
        n.alias("event_id"), at(F.floor(n / 10) % 600).alias("ts"), (F.col("user_id") % 10).alias("who"), (n * 11 % F.floor(roles.span(spark, sf, "events", "event_id") / 30)).alias("message_id"),
        F.when(n % 2 == 0, "👍").otherwise("😂").alias("emoji"))
    seconds = F.unix_timestamp(F.col("deleted_at").cast("timestamp"))
    return raw, deletions(spark, sf, e).withColumn("deleted_at", at(seconds % 600))


@register("reaction_outcomes", OUTCOME_SQL + " select event_id, status_code from told")
def reaction_outcomes(spark, sf):
    raw, lost = reactions(spark, sf)
    return ev.reaction_outcomes(raw, lost, "message_id", "who", "emoji", "ts", "event_id").select("event_id", "status_code")


@register("remaining_reactions", OUTCOME_SQL + """, odd as (select message_id, emoji, who from told join raw using (event_id) where status_code in ('added', 'removed') group by all having count(*) % 2 = 1)
 select message_id, emoji, count(*) total from odd where message_id not in (select message_id from lost) group by 1, 2""")
def remaining_reactions(spark, sf):
    raw, lost = reactions(spark, sf)
    told = ev.reaction_outcomes(raw, lost, "message_id", "who", "emoji", "ts", "event_id")
    return ev.remaining_reactions(told, lost, "message_id", "who", "emoji")


@register("document_lifecycle", """with recursive a as (select event_id, user_id k, event_id % 3 d, event_type in ('purchase', 'signup') starts, row_number() over (partition by user_id order by ts, event_id) rn
  from events where event_type in ('purchase', 'signup', 'error', 'view')),
 w as (select k, 0::bigint rn, null::bigint event_id, null::varchar code, null::bigint obsoleted, ['draft', 'draft', 'draft'] st from (select distinct k from a) union all
  select a.k, a.rn, a.event_id, case when starts then case when st[d + 1] = 'active' then 'already_active' else 'activated' end
    else case st[d + 1] when 'active' then 'deactivated' when 'inactive' then 'already_inactive' else 'document_not_active' end end,
   case when starts and st[d + 1] <> 'active' and list_position(st, 'active') > 0 then list_position(st, 'active') - 1 end,
   [case when starts and d = i then 'active' when starts and st[i + 1] = 'active' then 'obsolete' when not starts and d = i and st[i + 1] = 'active' then 'inactive' else st[i + 1] end for i in range(3)]
  from w join a on a.k = w.k and a.rn = w.rn + 1)
select event_id, code status_code, obsoleted from w where rn > 0""")
def document_lifecycle(spark, sf):
    e = roles.events(spark, sf).where("event_type in ('purchase', 'signup', 'error', 'view')")
    acts = e.select("event_id", "ts", F.col("user_id").alias("document_key"), (F.col("event_id") % 3).alias("document_id"),
                    F.when(F.col("event_type").isin("purchase", "signup"), "activate").otherwise("deactivate").alias("action"))
    return ev.document_lifecycle(acts, ["document_key"], "document_id", "ts", "event_id").select("event_id", "status_code", "obsoleted")


@register("revision_chains", """with recursive raw as (select o_orderkey op_id, o_orderdate tm, case when o_custkey % 10 < 9 then 0 else o_custkey end set_id,
  1 + cast(floor(datediff('day', (select min(o_orderdate)::date from orders), o_orderdate::date) / 20) as bigint) expected from orders),
 o as (select *, row_number() over (partition by set_id order by tm, op_id) pos from raw),
 w as (select set_id, 1::bigint rev, 0::bigint pos from (select distinct set_id from o) union all
  select set_id, rev + 1, pos from (select o.set_id, w.rev, o.pos, row_number() over (partition by o.set_id order by o.pos) k from w join o on o.set_id = w.set_id and o.expected = w.rev and o.pos > w.pos) where k = 1),
 c as (select o.*, w.pos is not null ok, 1 + count(w.pos) over (partition by o.set_id order by o.pos) cur from o left join w on w.set_id = o.set_id and w.pos = o.pos and w.pos > 0)
select op_id, case when ok then 'saved' else 'revision_conflict' end status_code, cur::bigint current_revision from c""")
def revision_chains(spark, sf):
    """Nine tenths of all operations are on one set; what they expect rises every twenty days."""
    o = read_table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), o.agg(F.min("o_orderdate")).scalar().cast("date"))
    ops = o.select(
        F.col("o_orderkey").alias("op_id"), F.col("o_orderdate").alias("at"),
        F.when(F.col("o_custkey") % 10 < 9, F.lit(0).cast("long")).otherwise(F.col("o_custkey")).alias("set_id"), (1 + F.floor(day / 20)).alias("expected_revision"))
    sets = ops.select("set_id").distinct().withColumn("revision", F.lit(1).cast("long"))
    return revisions.revision_conflicts(ops, sets, "set_id", "at", "op_id").select("op_id", "status_code", "current_revision")


@register("interval_overlaps", """with v as (select o_orderkey id, o_custkey k, o_orderdate a, case when o_orderkey % 97 <> 0 then o_orderdate + to_days(cast(1 + o_orderkey % 40 as integer)) end z from orders)
select x.k o_custkey, x.id first_id, y.id second_id, strftime(y.a, '%Y-%m-%d') overlap_from, strftime(nullif(least(coalesce(x.z, timestamp '9999-01-01'), coalesce(y.z, timestamp '9999-01-01')), timestamp '9999-01-01'), '%Y-%m-%d') overlap_to
from v x join v y on x.k = y.k and (x.a, x.id) < (y.a, y.id) and y.a < coalesce(x.z, timestamp '9999-01-01')""")
def interval_overlaps(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    held = o.select(k, "o_custkey", F.col("o_orderdate").alias("a"), F.when(k % 97 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(1 + k % 40).cast("int"))).alias("z"))
    found = intervals.overlap_report(held, ["o_custkey"], "a", "z", "o_orderkey", 30 * 86_400)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("o_custkey", "first_id", "second_id", day("overlap_from"), day("overlap_to"))


@register("faq_needles", """with n as (select item_id, item_id % 4 tenant, lower(trim(substr(text, cast(1 + item_id % 7 as bigint), cast(1 + item_id % 9 as bigint)))) needle from benchmark)
select doc_id, item_id from documents d join n on n.tenant = d.doc_id % 4 and contains(lower(d.text), n.needle)""")
def faq_needles(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("tenant"), "text")
    b = read_table(spark, sf, "benchmark")
    i = F.col("item_id")
    asked = b.select("item_id", (i % 4).alias("tenant"), F.substring(F.col("text"), 1 + i % 7, 1 + i % 9).alias("needle"))
    return needles.find_needles(d, asked, "tenant", "doc_id", "text", "item_id", "needle").select("doc_id", "item_id")


@register("latency_percentiles", "with " + relational.LOG_SQL + """ select institution_id, count(*) requests, count(distinct date_trunc('hour', ts)) merged, true p50_ok, true p95_ok, true p99_ok from log group by 1""")
def latency_percentiles(spark, sf):
    """Percentiles from merged hourly sketches, each judged by its true rank in the log: at most 2 % off."""
    log = relational.request_log(spark, sf)
    hourly = reporting.duration_sketches(log.withColumn("hour", ev.hour_of("ts")), ["institution_id", "hour"])
    found = reporting.sketch_percentiles(reporting.merge_sketches(hourly, ["institution_id"]))
    ranks = log.join(found, "institution_id").groupBy("institution_id", "requests", "merged").agg(
        *[F.avg((F.col("duration_ms") <= F.col(f"p{p}")).cast("double")).alias(f"r{p}") for p in (50, 95, 99)])
    return ranks.select("institution_id", "requests", "merged", *[(F.abs(F.col(f"r{p}") - p / 100) <= 0.02).alias(f"p{p}_ok") for p in (50, 95, 99)])
