"""Rate limits, chat state and histories over the event and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.functions.columns import epoch_bucket
from agoradesk.operators import events as ev
from agoradesk.operators import limits, revisions
from agoradesk.plans import roles
from agoradesk.plans.roles import NOW
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


def cascade_sql(window: str, scopes: list[tuple[str, str, int]]) -> str:
    """The same cascade as nested numbered subqueries."""
    inner = f"select event_id, ts, user_id device, event_type token, user_id % 40 ip, event_type institution, {window} w, cast(null as varchar) rejected_by from events"
    for name, key, limit in scopes:
        inner = f"""select * exclude (rejected_by, n), n {name}_count, coalesce(rejected_by, case when n > {limit} then '{name}' end) rejected_by from
          (select *, case when rejected_by is null then row_number() over (partition by {key}, w, rejected_by is null order by ts, event_id) end n from ({inner}))"""
    return inner


def attempts(spark, sf):
    return roles.events(spark, sf).select(
        "event_id", "ts", F.col("user_id").alias("device"), F.col("event_type").alias("token"), (F.col("user_id") % 40).alias("ip"),
        F.col("event_type").alias("institution"))


@register("hourly_request_limits", "select event_id, device_count, ip_count, institution_count, rejected_by from (" + cascade_sql(
    "date_trunc('hour', ts)", [("device", "device", 1), ("ip", "ip", 1), ("institution", "institution", 2)]) + ")")
def hourly_request_limits(spark, sf):
    out = limits.tumbling_limits(attempts(spark, sf), [("device", "device", 1), ("ip", "ip", 1), ("institution", "institution", 2)],
                                 ev.hour_of("ts"), ["ts", "event_id"])
    return out.select("event_id", "device_count", "ip_count", "institution_count", "rejected_by")


@register("ten_minute_activation_limits", "select event_id, device_count, token_count, ip_count, rejected_by from (" + cascade_sql(
    "time_bucket(interval 10 minute, ts)", [("device", "device", 5), ("token", "token", 1), ("ip", "ip", 20)]) + ")")
def ten_minute_activation_limits(spark, sf):
    out = limits.tumbling_limits(attempts(spark, sf), [("device", "device", 5), ("token", "token", 1), ("ip", "ip", 20)],
                                 epoch_bucket(F.col("ts"), 600), ["ts", "event_id"])
    return out.select("event_id", "device_count", "token_count", "ip_count", "rejected_by")


@register("saturating_uploads", """select event_id, n <= 2 accepted, least(n, 2) counter from (select event_id,
 row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) n from events)""")
def saturating_uploads(spark, sf):
    out = limits.saturating_limit(attempts(spark, sf), "institution", ev.hour_of("ts"), ["ts", "event_id"], 2)
    return out.select("event_id", "accepted", "counter")


SLIDING_SQL = """with recursive e as (select {key} k, event_id, epoch_us(ts) tm, row_number() over (partition by {key} order by ts, event_id) rn from events),
walk as (select k, rn, event_id, true accepted, [tm] acc from e where rn = 1
  union all select e.k, e.rn, e.event_id, ok, case when ok then list_append(recent, e.tm) else recent end from
   (select e.*, recent, {ok} ok from (select e.*, list_filter(w.acc, lambda a: a >= e.tm - 3600000000) recent
      from walk w join e on e.k = w.k and e.rn = w.rn + 1) e) e)
select event_id, accepted from walk"""


@register("sliding_message_limit", SLIDING_SQL.format(
    key="event_type", ok="len(list_filter(recent, lambda a: a >= e.tm - 60000000)) < 2 and len(recent) < 3"))
def sliding_message_limit(spark, sf):
    out = limits.sliding_limit(roles.events(spark, sf).select("event_type", "event_id", "ts"), ["event_type"], "ts", "event_id", ((60, 2), (3600, 3)))
    return out.select("event_id", "accepted")


@register("sliding_limit_screen", """select event_id, count(*) over (partition by event_type order by ts range between interval 60 second preceding and current row) within_60s,
 count(*) over (partition by event_type order by ts range between interval 3600 second preceding and current row) within_3600s from events""")
def sliding_limit_screen(spark, sf):
    out = limits.sliding_screen(roles.events(spark, sf).select("event_type", "event_id", "ts"), ["event_type"], "ts")
    return out.select("event_id", "within_60s", "within_3600s")


@register("duplicate_messages", """with recursive e as (select event_type k, event_id, epoch_us(ts) tm, row_number() over (partition by event_type order by ts, event_id) rn from events),
walk as (select k, rn, event_id, tm anchor, event_id kept from e where rn = 1 union all
  select e.k, e.rn, e.event_id, case when w.anchor >= e.tm - 900000000 then w.anchor else e.tm end, case when w.anchor >= e.tm - 900000000 then w.kept else e.event_id end
  from walk w join e on e.k = w.k and e.rn = w.rn + 1)
select event_id, cast(kept as varchar) kept_id from walk""")
def duplicate_messages(spark, sf):
    out = limits.suppress_duplicates(roles.events(spark, sf).select("event_type", "event_id", "ts"), ["event_type"], "ts", "event_id", 900)
    return out.select("event_id", "kept_id")


REACT_SQL = "react as (select event_id, ts, user_id, event_id % (select (max(event_id) + 1) * 2 // 100 from events) message_id, case event_id % 3 when 0 then '👍' when 1 then '❤️' else '😂' end emoji from events where event_type in ('click', 'view'))"


def reactions(spark, sf):
    e = roles.events(spark, sf).where("event_type in ('click', 'view')")
    raw = F.when(F.col("event_id") % 3 == 0, "👍").when(F.col("event_id") % 3 == 1, "❤").otherwise(" 😂 ")
    return e.select("event_id", "ts", "user_id", (F.col("event_id") % roles.span(spark, sf, "events", "event_id", 2)).alias("message_id"), ev.emoji(raw).alias("emoji"))


@register("reaction_toggles", "with " + REACT_SQL + """ select event_id, case when row_number() over (partition by message_id, user_id % 9, emoji order by ts, event_id) % 2 = 1
 then 'added' else 'removed' end as action from react""")
def reaction_toggles(spark, sf):
    rows = reactions(spark, sf).withColumn("who", F.col("user_id") % 9)
    return ev.toggle_actions(rows, ["message_id", "who", "emoji"], "ts", "event_id").select("event_id", "action")


@register("reaction_counts", "with " + REACT_SQL + """ select message_id, string_agg(emoji || '=' || n, ',' order by emoji) counts from (select message_id, emoji, count(*) n from
 (select message_id, user_id % 9, emoji, count(*) c from react group by all) where c % 2 = 1 group by 1, 2) group by 1""")
def reaction_counts(spark, sf):
    rows = reactions(spark, sf).withColumn("who", F.col("user_id") % 9)
    counts = ev.reaction_counts(ev.toggle_state(rows, ["message_id", "who", "emoji"]), ["message_id"], "emoji")
    pairs = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return counts.select("message_id", F.array_join(pairs, ",").alias("counts"))


@register("read_marks", """select coalesce('ext-' || case when user_id % 3 = 0 then user_id end, cast(user_id as varchar)) person, event_type channel,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_read_at from events group by 1, 2""")
def read_marks(spark, sf):
    legacy = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("ext-"), F.col("user_id").cast("string")))
    rows = roles.events(spark, sf).select(ev.person(legacy, F.col("user_id")).alias("person"), F.col("event_type").alias("channel"), "ts")
    return ev.read_marks(rows, ["person", "channel"], "ts").withColumn("last_read_at", F.date_format("last_read_at", "yyyy-MM-dd HH:mm:ss"))


@register("last_seen", "select user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') last_seen_at from events group by 1")
def last_seen(spark, sf):
    return ev.last_seen(roles.events(spark, sf), "user_id", "ts").withColumn("last_seen_at", F.date_format("last_seen_at", "yyyy-MM-dd HH:mm:ss"))


PIN_AT = "2024-01-30 12:00:00"


@register("pins", f"""with a as (select event_id, ts, user_id channel, event_id % 4 message_id, case when event_type in ('purchase', 'view', 'click') then 'pin' when event_type = 'error' then 'unpin' else 'delete' end act,
  ['1h', '4h', '1j', '3j'][1 + event_id % 4] duration from events),
 last as (select channel, arg_max(a, (ts, event_id)) l from a where act <> 'delete' group by 1),
 rem as (select channel, message_id, max((ts, event_id)) r from a where act = 'delete' group by 1, 2)
select last.channel, l.message_id message_id, coalesce(l.act = 'pin' and coalesce(not (rem.r > (l.ts, l.event_id)), true)
  and l.ts + to_hours(case l.duration when '1h' then 1 when '4h' then 4 when '1j' then 24 else 72 end) > timestamp '{PIN_AT}', false) pinned
from last left join rem on rem.channel = last.channel and rem.message_id = l.message_id""")
def pins(spark, sf):
    e = roles.events(spark, sf)
    acts = e.select(
        "event_id", "ts", F.col("user_id").alias("channel"), (F.col("event_id") % 4).alias("message_id"),
        F.when(F.col("event_type").isin("purchase", "view", "click"), "pin").when(F.col("event_type") == "error", "unpin").otherwise("delete").alias("action"),
        F.element_at(F.array(*[F.lit(d) for d in ev.PIN_HOURS]), (1 + F.col("event_id") % 4).cast("int")).alias("duration"))
    out = ev.pin_state(acts, ["channel"], "ts", "event_id", F.lit(PIN_AT).cast("timestamp_ntz"))
    return out.select("channel", "message_id", "pinned")


@register("request_lifecycle", f"""with r as (select event_id request_id, user_id device_id, ts created_at, ts + interval 24 hour expires_at,
  lead(ts) over (partition by user_id order by ts, event_id) next_at from events where event_type = 'signup'),
 d as (select (event_id * 3) % (select (max(event_id) + 1) * 100 // 100 from events) request_id, case when event_type = 'purchase' then 'approved' else 'cancelled' end decision, ts decided_at from events where event_type in ('purchase', 'error')),
 f as (select request_id, arg_min(decision, decided_at) decision, min(decided_at) decided_at from d group by 1)
select request_id, case when decided_at < least(coalesce(next_at, expires_at), expires_at) and decided_at <= timestamp '{NOW}' then decision
  when next_at < expires_at and next_at <= timestamp '{NOW}' then 'cancelled' when expires_at <= timestamp '{NOW}' then 'expired' else 'pending' end status
from r left join f using (request_id)""")
def request_lifecycle(spark, sf):
    e = roles.events(spark, sf)
    asked = e.where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("device_id"), F.col("ts").alias("created_at"))
    settled = e.where("event_type in ('purchase', 'error')").select(
        (F.col("event_id") * 3 % roles.span(spark, sf, "events", "event_id", 100)).alias("request_id"), F.when(F.col("event_type") == "purchase", "approved").otherwise("cancelled").alias("decision"),
        F.col("ts").alias("decided_at"))
    return ev.request_state(asked, settled, roles.now()).select("request_id", "status")


@register("message_states", """with m as (select conv_id * 1000 + turn message_id, conv_id channel, text body, case when turn > 0 then conv_id * 1000 + turn - 1 end reply_to from conversations),
 ed as (select (event_id % (select (max(conv_id) + 1) * 100 // 100 from conversations)) * 1000 + event_id % 6 message_id, ts tm, case when event_type = 'error' then 'delete' when event_type = 'view' then 'edit' end act, 'v' || event_id body from events where event_type in ('error', 'view') and event_id % 5 = 0),
 gone as (select message_id, min(tm) deleted_at from ed where act = 'delete' group by 1),
 last as (select message_id, arg_max(body, tm) new_body from ed left join gone using (message_id) where act = 'edit' and (deleted_at is null or tm < deleted_at) group by 1),
 s as (select message_id, reply_to, case when deleted_at is not null then '' else coalesce(new_body, body) end body, new_body is not null and deleted_at is null edited, deleted_at is not null deleted
   from m left join gone using (message_id) left join last using (message_id))
select s.message_id, sha256(s.body) body_sha, s.edited, s.deleted, sha256(case when p.deleted then 'Message supprimé' else p.body end) preview_sha
from s left join s p on p.message_id = s.reply_to""")
def message_states(spark, sf):
    c = read_table(spark, sf, "conversations")
    mid = F.col("conv_id") * 1000 + F.col("turn")
    msgs = c.select(mid.alias("message_id"), F.col("conv_id").alias("channel"), F.col("text").alias("body"), F.when(F.col("turn") > 0, mid - 1).alias("reply_to"))
    e = roles.events(spark, sf).where("event_type in ('error', 'view') and event_id % 5 = 0")
    edits = e.select(((F.col("event_id") % roles.span(spark, sf, "conversations", "conv_id", 100)) * 1000 + F.col("event_id") % 6).alias("message_id"), F.col("ts").alias("at"),
                     F.when(F.col("event_type") == "error", "delete").otherwise("edit").alias("action"),
                     F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("body"))
    out = ev.message_state(msgs, edits)
    return out.select("message_id", F.sha2("body", 256).alias("body_sha"), "edited", "deleted", F.sha2("reply_preview", 256).alias("preview_sha"))


@register("document_versions", """select o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') valid_from,
 strftime(lead(o_orderdate) over w, '%Y-%m-%d') valid_to, lead(o_orderkey) over w replaced_by, case when lead(o_orderkey) over w is null then 'active' else 'obsolete' end status
 from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def document_versions(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = ev.document_versions(o, ["o_custkey"], "o_orderdate", "o_orderkey", F.date_trunc("month", "o_orderdate"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return out.select("o_orderkey", "o_custkey", day("valid_from"), day("valid_to"), "replaced_by", "status")


HISTORY_SQL = """h as (select o_custkey content_id, o_orderdate tm, o_orderkey version, ['draft', 'needs_review', 'validated', 'published', 'archived'][1 + (o_orderkey * 7) % 5] status,
  o_orderpriority title from orders)"""


def history(spark, sf):
    o = read_table(spark, sf, "orders")
    steps = F.array(*[F.lit(s) for s in ("draft", "needs_review", "validated", "published", "archived")])
    return o.select(F.col("o_custkey").alias("content_id"), F.col("o_orderdate").alias("tm"), F.col("o_orderkey").alias("version"),
                    F.element_at(steps, (1 + F.col("o_orderkey") * 7 % 5).cast("int")).alias("status"), F.col("o_orderpriority").alias("title"))


LEGAL = "', '".join(f"{a}>{b}" for a, b in ev.EDITORIAL_STEPS)


@register("illegal_transitions", "with " + HISTORY_SQL + f""" select version, from_status, status from (select *, lag(status) over (partition by content_id order by tm, version) from_status from h)
 where coalesce(from_status, '') || '>' || status not in ('{LEGAL}', '>draft')""")
def illegal_transitions(spark, sf):
    out = ev.illegal_transitions(history(spark, sf), ["content_id"], ["tm", "version"], F.date_trunc("month", "tm"))
    return out.select("version", "from_status", "status")


@register("immutable_changes", "with " + HISTORY_SQL + """ select version, from_status, status from (select *, lag(status) over w from_status, lag(title) over w was from h window w as (partition by content_id order by tm, version))
 where (from_status in ('validated', 'published') and was is distinct from title) or from_status = 'archived'""")
def immutable_changes(spark, sf):
    out = ev.immutable_changes(history(spark, sf), ["content_id"], ["tm", "version"], F.date_trunc("month", "tm"))
    return out.select("version", "from_status", "status")


@register("editorial_stamps", "with " + HISTORY_SQL + f""", m as (select *, lag(status) over (partition by content_id order by tm, version) old_status from h),
 s as (select *, status in ('draft', 'needs_review') and status is distinct from old_status reopened, status = 'archived' and old_status is distinct from 'archived' archived from m)
select version, case when not reopened then title end validated_by, case when archived then false else true end active,
 case when archived then strftime(timestamp '{NOW}', '%Y-%m-%d') end archived_on from s""")
def editorial_stamps(spark, sf):
    from agoradesk.operators.ordered import with_neighbours

    moved = with_neighbours(history(spark, sf), ["content_id"], ["tm", "version"], F.date_trunc("month", "tm"), lag={"old_status": F.col("status")})
    rows = moved.withColumns({"validated_by": F.col("title"), "active": F.lit(True), "archived_at": F.lit(None).cast("timestamp_ntz")})
    out = ev.apply_editorial(rows, "old_status", roles.now())
    return out.select("version", "validated_by", "active", F.date_format("archived_at", "yyyy-MM-dd").alias("archived_on"))


@register("operation_replays", """with o as (select event_id, ts, user_id, event_type payload, event_id % (select (max(event_id) + 1) * 10 // 100 from events) operation_id from events),
 f as (select user_id % 25 t, operation_id, arg_min(payload, (ts, event_id)) p, min((ts, event_id)) a from o group by 1, 2)
select event_id, case when (ts, event_id) = a then 'first' when payload = p then 'replayed' else 'idempotency_conflict' end outcome
from o join f on f.t = o.user_id % 25 and f.operation_id = o.operation_id""")
def operation_replays(spark, sf):
    ops = roles.events(spark, sf).select("event_id", "ts", (F.col("user_id") % 25).alias("tenant"), F.col("event_type").alias("payload"), (F.col("event_id") % roles.span(spark, sf, "events", "event_id", 10)).alias("operation_id"))
    return ev.dedupe_operations(ops, ["tenant", "operation_id"], ["ts", "event_id"], ["payload"]).select("event_id", "outcome")


@register("revision_conflicts", """with recursive o as (select event_id, user_id set_id, 1 + event_id % 3 expected, row_number() over (partition by user_id order by ts, event_id) rn from events),
 w as (select set_id, rn, event_id, expected = 1 ok, case when expected = 1 then 2 else 1 end cur from o where rn = 1 union all
  select o.set_id, o.rn, o.event_id, o.expected = w.cur, case when o.expected = w.cur then w.cur + 1 else w.cur end from w join o on o.set_id = w.set_id and o.rn = w.rn + 1)
select event_id, case when ok then 'saved' else 'revision_conflict' end status_code, cast(cur as bigint) current_revision from w""")
def revision_conflicts(spark, sf):
    e = roles.events(spark, sf)
    ops = e.select("event_id", "ts", F.col("user_id").alias("set_id"), (1 + F.col("event_id") % 3).alias("expected_revision"))
    sets = e.select(F.col("user_id").alias("set_id")).distinct().withColumn("revision", F.lit(1).cast("long"))
    return revisions.revision_conflicts(ops, sets, "set_id", "ts", "event_id").select("event_id", "status_code", "current_revision")


TOKENS_SQL = """tokens as (select c_custkey token_id, 'h' || c_custkey token_hash, case when c_custkey % 2 = 0 then 'qr' else 'manual_code' end as "method",
  case when c_custkey % 13 = 0 then timestamp '2024-01-01' end consumed_at, case when c_custkey % 17 = 0 then timestamp '2024-01-01' end invalidated_at,
  timestamp '2024-01-01' + to_hours(cast(c_custkey % 900 as integer)) token_expires_at from customer),
 att as (select event_id, ts, 'h' || ((event_id * 11) % (select (max(c_custkey) + 1) * 113 // 100 from customer)) token_hash, case when event_type = 'error' then 'mcp' when (event_id * 11) % (select (max(c_custkey) + 1) * 113 // 100 from customer) % 2 = 0 then 'qr' else 'manual_code' end as "method" from events)"""
TOKEN_CASE = """case when token_id is null then 'token_not_found' when consumed_at is not null then 'token_already_consumed'
  when invalidated_at is not null then 'token_invalidated' when token_expires_at <= {now} then 'token_expired' else 'valid' end"""


def token_tables(spark, sf):
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    tokens = c.select(
        k.alias("token_id"), F.concat(F.lit("h"), k.cast("string")).alias("token_hash"), F.when(k % 2 == 0, "qr").otherwise("manual_code").alias("method"),
        F.when(k % 13 == 0, stamp).alias("consumed_at"), F.when(k % 17 == 0, stamp).alias("invalidated_at"),
        (stamp + F.make_dt_interval(hours=(k % 900).cast("int"))).alias("token_expires_at"))
    n = F.col("event_id") * 11 % roles.span(spark, sf, "customer", "c_custkey", 113)
    att = roles.events(spark, sf).select(
        "event_id", "ts", F.concat(F.lit("h"), n.cast("string")).alias("token_hash"),
        F.when(F.col("event_type") == "error", "mcp").when(n % 2 == 0, "qr").otherwise("manual_code").alias("method"))
    return att, tokens


@register("token_states", "with " + TOKENS_SQL + " select event_id, " + TOKEN_CASE.format(now="timestamp '2024-01-20'") + """ token_state
 from att left join tokens using (token_hash, "method")""")
def token_states(spark, sf):
    att, tokens = token_tables(spark, sf)
    return ev.classify_tokens(att, tokens, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "token_state")


@register("activations", "with " + TOKENS_SQL + ", j as (select *, " + TOKEN_CASE.format(now="ts") + """ st from att left join tokens using (token_hash, "method"))
select event_id, case when st <> 'valid' then st when row_number() over (partition by token_id, st order by ts, event_id) = 1 then 'success' else 'token_already_consumed' end status_code from j""")
def activations(spark, sf):
    att, tokens = token_tables(spark, sf)
    return ev.apply_activations(att, tokens, ["ts", "event_id"]).select("event_id", "status_code")
