"""Relational core on the tenant tables: identity, lists, counts, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.functions.columns import is_distinct
from agoradesk.operators import access, quality, reporting
from agoradesk.operators.ordered import latest_per_key
from agoradesk.operators.retrieval import lookup_ids
from agoradesk.plans import roles
from agoradesk.plans.roles import NOW, with_roles
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


def text(col: str):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


ACTIVE_SQL = """active_devices as (select d.*, u.institution_id from devices d join users u using (user_id)
    join institutions i using (institution_id) where d.activated_at is not null and d.revoked_at is null
    and u.active and i.active)"""
OPEN_SQL = """open_memberships as (select m.* from memberships m join channels c using (institution_id, channel_id) where c.enabled)"""


def active(spark, sf):
    return access.active_devices(roles.devices(spark, sf), roles.users(spark, sf), roles.institutions(spark, sf))


@register("user_dashboard", with_roles("users", "memberships", "channels", "devices") + """
select u.user_id, u.institution_id, u.display_name, u.active, coalesce(c.channels, '') channels,
  coalesce(d.device_count, 0) device_count, strftime(d.last_seen_at, '%Y-%m-%d %H:%M:%S') last_seen_at
from users u left join (select user_id, institution_id, string_agg(distinct label, ',' order by label) channels
   from memberships join channels using (institution_id, channel_id) group by 1, 2) c using (user_id, institution_id)
 left join (select user_id, count(distinct device_id) filter (where revoked_at is null) device_count,
   max(last_seen_at) last_seen_at from devices group by 1) d using (user_id)""")
def user_dashboard(spark, sf):
    board = reporting.user_dashboard(roles.users(spark, sf), roles.memberships(spark, sf), roles.channels(spark, sf), roles.devices(spark, sf))
    return board.select("user_id", "institution_id", "display_name", "active", F.array_join("channels", ",").alias("channels"),
                        "device_count", text("last_seen_at").alias("last_seen_at"))


@register("active_devices", with_roles("institutions", "users", "devices") + "," + ACTIVE_SQL + """
select device_id, user_id, institution_id from active_devices""")
def active_devices(spark, sf):
    return active(spark, sf).select("device_id", "user_id", "institution_id")


@register("visible_channels", with_roles("institutions", "users", "devices", "memberships", "channels") + "," + ACTIVE_SQL + "," + OPEN_SQL + """
select institution_id, channel_id, count(*) devices from active_devices join open_memberships using (user_id, institution_id)
group by 1, 2""")
def visible_channels(spark, sf):
    seen = access.visible_channels(active(spark, sf), roles.memberships(spark, sf), roles.channels(spark, sf))
    return seen.groupBy("institution_id", "channel_id").agg(F.count("*").alias("devices"))


@register("visible_messages", with_roles("users", "memberships", "channels") + "," + OPEN_SQL + """,
messages as (select event_id, user_id, institution_id, 'brand' || (1 + event_id % 25) channel_id from events join users using (user_id))
select event_id, user_id, institution_id, channel_id from messages semi join open_memberships using (user_id, institution_id, channel_id)""")
def visible_messages(spark, sf):
    users = roles.users(spark, sf)
    sent = roles.events(spark, sf).join(users.select("user_id", "institution_id"), "user_id").select(
        "event_id", "user_id", "institution_id", F.concat(F.lit("brand"), (1 + F.col("event_id") % 25).cast("string")).alias("channel_id")
    )
    rows = access.visible_rows(sent, users, roles.memberships(spark, sf), roles.channels(spark, sf))
    return rows.select("event_id", "user_id", "institution_id", "channel_id")


@register("role_holders", with_roles("users") + """
select u.user_id, u.institution_id, 'admin' as role from users u where segment = 'MACHINERY'""")
def role_holders(spark, sf):
    users = roles.users(spark, sf)
    held = users.select("user_id", F.when(F.col("segment") == "MACHINERY", "admin").when(F.col("segment") == "BUILDING", "cadre")
                        .otherwise("guest").alias("role"))
    return access.with_role(users, held, "admin").select("user_id", "institution_id", F.lit("admin").alias("role"))


@register("own_events", with_roles("institutions", "users", "devices") + "," + ACTIVE_SQL + """
select e.event_id, e.user_id from events e semi join active_devices d on e.user_id = d.user_id""")
def own_events(spark, sf):
    return access.own_rows(roles.events(spark, sf).select("event_id", "user_id"), active(spark, sf))


@register("optional_filters", """select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'O') and o_orderpriority = '1-URGENT'""")
def optional_filters(spark, sf):
    rows = quality.filter_optional(read_table(spark, sf, "orders"), o_orderstatus=["F", "O"], o_orderpriority="1-URGENT", o_custkey=None)
    return rows.select("o_orderkey", "o_orderstatus")


@register("owner_changes", with_roles("users", "devices") + """
select d.device_id, d.user_id, u.user_id as owner_id from devices d left join users u on u.user_id = d.user_id and u.active
where d.user_id is distinct from u.user_id""")
def owner_changes(spark, sf):
    owners = roles.users(spark, sf).where("active").select(F.col("user_id").alias("owner_id"))
    devices = roles.devices(spark, sf)
    rows = devices.join(owners, devices.user_id == owners.owner_id, "left")
    return rows.where(is_distinct(F.col("user_id"), F.col("owner_id"))).select("device_id", "user_id", "owner_id")


REQUESTS_SQL = """requests as (select event_id request_id, (event_id * 7) % (select (max(o_orderkey) + 1) * 133 // 100 from orders) device_id, ts created_at, ts + interval 24 hour expires_at,
  case when event_type = 'signup' then 'pending' when event_type = 'error' then 'cancelled' else 'approved' end status,
  (user_id % 25) institution_id from events)"""


def requests(spark, sf):
    e = roles.events(spark, sf)
    return e.select(
        F.col("event_id").alias("request_id"), (F.col("event_id") * 7 % roles.span(spark, sf, "orders", "o_orderkey", 133)).alias("device_id"), F.col("ts").alias("created_at"),
        F.expr("ts + interval 24 hours").alias("expires_at"),
        F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "error", "cancelled").otherwise("approved").alias("status"),
        (F.col("user_id") % 25).alias("institution_id"),
    )


@register("access_states", with_roles("users", "devices") + "," + REQUESTS_SQL + f""",
last as (select device_id, arg_max(request_id, (created_at, request_id)) pending_request_id from requests
  where status = 'pending' and expires_at > timestamp '{NOW}' group by 1)
select device_id, pending_request_id, case
  when d.revoked_at is not null then 'device_revoked'
  when d.activated_at is null or d.user_id is null then
     case when pending_request_id is not null then 'pending_activation' else 'activation_required' end
  when u.user_id is null then 'user_unknown' when not u.active then 'user_inactive' else 'active' end access_state
from (select * from devices full join (select distinct device_id from requests) using (device_id)) d
 left join last using (device_id) left join users u on u.user_id = d.user_id""")
def access_states(spark, sf):
    rows = access.classify_access(roles.devices(spark, sf), requests(spark, sf), roles.users(spark, sf), roles.now())
    return rows.select("device_id", "pending_request_id", "access_state")


@register("open_access_windows", with_roles("users") + f"""
select c_custkey user_id from customer join (select o_custkey, max(o_orderdate) granted_at,
  max(o_orderdate) + interval 26 year expires_at, bool_or(o_orderstatus = 'F' and o_totalprice > 400000) revoked from orders group by 1)
 on o_custkey = c_custkey where not revoked and granted_at <= timestamp '{NOW}' and expires_at > timestamp '{NOW}'""")
def open_access_windows(spark, sf):
    o = read_table(spark, sf, "orders")
    granted = o.groupBy(F.col("o_custkey").alias("user_id")).agg(
        F.max("o_orderdate").alias("granted_at"), F.bool_or((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 400000)).alias("_r")
    )
    granted = granted.withColumns({"expires_at": F.expr("granted_at + interval 26 years"), "revoked_at": F.when(F.col("_r"), F.col("granted_at"))})
    return access.active_access(granted, roles.now()).select("user_id")


@register("channel_selections", with_roles("channels") + """,
picked as (select o_orderkey, cast(c_nationkey as bigint) institution_id, list_sort(list_distinct(list_append(list(
   'brand' || (1 + l_partkey % 26)), 'all'))) channel_ids from lineitem join orders on l_orderkey = o_orderkey
   join customer on c_custkey = o_custkey group by 1, 2),
allch as (select institution_id, channel_id, enabled from channels union all select distinct institution_id, 'all', true from channels),
bad as (select p.o_orderkey, count(*) n from (select o_orderkey, institution_id, unnest(channel_ids) channel_id from picked) p
  left join allch c on c.institution_id = p.institution_id and c.channel_id = p.channel_id and c.enabled where c.channel_id is null group by 1)
select o_orderkey, array_to_string(channel_ids, ',') channel_ids, coalesce(n, 0) invalid_channels,
  case when len(channel_ids) > 50 then 'too_many_channels' when coalesce(n, 0) > 0 then 'invalid_channel_selection' else 'ok' end status_code
from picked left join bad using (o_orderkey)""")
def channel_selections(spark, sf):
    line = read_table(spark, sf, "lineitem").select("l_orderkey", F.concat(F.lit(" brand"), (1 + F.col("l_partkey") % 26).cast("string"), F.lit(" ")).alias("c"))
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("institution_id"))
    asked = line.groupBy("l_orderkey").agg(F.collect_list("c").alias("channel_ids"))
    rows = asked.join(orders, asked.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    offered = roles.channels(spark, sf)
    everyone = roles.institutions(spark, sf).select("institution_id", F.lit("all").alias("channel_id"), F.lit("Tous").alias("label"), F.lit(True).alias("enabled"))
    out = access.clean_channels(rows.select("o_orderkey", "institution_id", "channel_ids"), "o_orderkey", offered.unionByName(everyone))
    return out.select("o_orderkey", F.array_join("channel_ids", ",").alias("channel_ids"), "invalid_channels", "status_code")


@register("user_matches", with_roles("users") + """,
req as (select event_id request_id, user_id % 25 institution_id, case when event_id % 4 <> 0 then (event_id * 13) % (select (max(c_custkey) + 1) * 107 // 100 from customer) end existing_user_id,
   case when event_id % 5 < 2 then 'ext-' || ((event_id * 13) % (select (max(c_custkey) + 1) * 107 // 100 from customer)) when event_id % 5 = 2 then 'ext-' || event_id end external_id from events),
holder as (select institution_id, external_id, min(user_id) holder from users where external_id is not null group by 1, 2)
select request_id, case
  when r.existing_user_id is null then case when r.external_id is not null and holder is not null then 'external_id_already_exists' else 'new_user' end
  when u.user_id is null then 'existing_user_not_found' when not u.active then 'existing_user_inactive'
  when r.external_id is not null and u.external_id <> r.external_id then 'external_id_mismatch'
  when holder <> r.existing_user_id then 'external_id_already_exists'
  when r.external_id is not null and u.external_id is null then 'filled' else 'matched' end match_status
from req r left join users u on u.user_id = r.existing_user_id and u.institution_id = r.institution_id
 left join holder h on h.institution_id = r.institution_id and h.external_id = r.external_id""")
def user_matches(spark, sf):
    e = roles.events(spark, sf)
    guess = F.col("event_id") * 13 % roles.span(spark, sf, "customer", "c_custkey", 107)
    req = e.select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 25).alias("institution_id"),
        F.when(F.col("event_id") % 4 != 0, guess).alias("existing_user_id"),
        F.when(F.col("event_id") % 5 < 2, F.concat(F.lit("ext-"), guess.cast("string")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("ext-"), F.col("event_id").cast("string"))).alias("external_id"),
    )
    return access.classify_user_match(req, roles.users(spark, sf)).select("request_id", "match_status")


@register("approval_views", with_roles("institutions") + "," + REQUESTS_SQL + f"""
select request_id, i.label institution_label, case when r.status = 'pending' and r.expires_at <= timestamp '{NOW}' then 'expired'
  when r.status <> 'pending' then 'request_not_pending' when i.label is null then 'institution_inactive' else 'success' end status_code
from requests r left join institutions i on i.institution_id = r.institution_id and i.active""")
def approval_views(spark, sf):
    rows = access.approval_view(requests(spark, sf), roles.institutions(spark, sf), roles.now())
    return rows.select("request_id", "institution_label", "status_code")


@register("presented_links", with_roles("institutions") + "," + REQUESTS_SQL + f""", links as (select 'l' || request_id link_hash, request_id from requests where request_id % 5 <> 0),
 shown as (select event_id presented_id, case when event_id % 11 <> 0 then 'l' || (event_id * 3) % (select (max(event_id) + 1) * 110 // 100 from events) end link_hash from events)
select presented_id, l.request_id, case when r.request_id is null then 'invalid_link' when r.status = 'pending' and r.expires_at <= timestamp '{NOW}' then 'expired'
  when r.status <> 'pending' then 'request_not_pending' when i.label is null then 'institution_inactive' else 'success' end status_code
from shown left join links l using (link_hash) left join requests r on r.request_id = l.request_id left join institutions i on i.institution_id = r.institution_id and i.active""")
def presented_links(spark, sf):
    asked = requests(spark, sf)
    links = asked.where("request_id % 5 <> 0").select(F.concat(F.lit("l"), "request_id").alias("link_hash"), "request_id")
    n = F.col("event_id")
    shown = roles.events(spark, sf).select(n.alias("presented_id"), F.when(n % 11 != 0, F.concat(F.lit("l"), n * 3 % roles.span(spark, sf, "events", "event_id", 110))).alias("link_hash"))
    out = access.presented_links(shown, links, asked, roles.institutions(spark, sf), roles.now())
    return out.select("presented_id", "request_id", "status_code")


@register("approval_choices", with_roles("users", "channels") + "," + REQUESTS_SQL + """,
t as (select distinct institution_id from requests)
select institution_id, 'channel' kind, channel_id item_id, label, '1|' || lower(label) || '|' || channel_id sort_key
from channels semi join t using (institution_id) where enabled
union all select institution_id, 'user', cast(user_id as varchar), display_name, '0|' || lower(display_name) || '|' || user_id
from users semi join t using (institution_id) where active""")
def approval_choices(spark, sf):
    return access.approval_choices(requests(spark, sf), roles.channels(spark, sf), roles.users(spark, sf))


@register("pending_requests", "with " + REQUESTS_SQL + f"""
select request_id, institution_id, strftime(created_at, '%Y-%m-%d %H:%M:%S') created_at from requests
where status = 'pending' and expires_at > timestamp '{NOW}'""")
def pending_requests(spark, sf):
    rows = reporting.pending_requests(requests(spark, sf), roles.now())
    return rows.orderBy(F.desc("created_at")).select("request_id", "institution_id", text("created_at").alias("created_at"))


@register("latest_order_per_customer", """select o_custkey, o_orderkey, o_orderstatus from (select *, row_number() over
 (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1""")
def latest_order(spark, sf):
    o = read_table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return latest_per_key(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderstatus")


DOCS_SQL = """docs as (select doc_id document_id, source institution_id, timestamp '2024-01-01' + to_hours(cast(doc_id % 700 as integer)) created_at from documents),
jobs as (select o_orderkey job_id, o_custkey document_id, o_orderstatus status, o_orderdate job_created_at from orders)"""


def doc_roles(spark, sf):
    d = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("source").alias("institution_id"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 700 as int))").alias("created_at"),
    )
    j = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("document_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("job_created_at"),
    )
    return d, j


@register("document_list", "with " + DOCS_SQL + """, ranked as (select *, row_number() over (partition by institution_id order by created_at desc,
 document_id desc) position from docs), last as (select *, row_number() over (partition by document_id order by job_created_at desc, job_id desc) rn from jobs)
select r.institution_id, r.document_id, r.position, l.job_id, l.status from ranked r left join last l on l.document_id = r.document_id and l.rn = 1""")
def document_list(spark, sf):
    docs, jobs = doc_roles(spark, sf)
    return reporting.list_documents(docs, jobs).select("institution_id", "document_id", "position", "job_id", "status")


@register("keyset_page", """with f as (select o_orderdate, o_orderkey from orders where (o_orderdate, o_orderkey) < (timestamp '1998-06-01', 500)
  order by o_orderdate desc, o_orderkey desc limit 101), p as (select * from f order by o_orderdate desc, o_orderkey desc limit 100)
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') o_orderdate, (select count(*) > 100 from f) has_more,
  (select case when (select count(*) > 100 from f) then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|' || o_orderkey end
   from p order by o_orderdate, o_orderkey limit 1) next_key from p""")
def keyset_page(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderdate", "o_orderkey")
    page = reporting.keyset_page(o, ["o_orderdate", "o_orderkey"], 100, ("1998-06-01 00:00:00", 500))
    key = F.unbase64("next_cursor").cast("string")
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "has_more", key.alias("next_key"))


@register("keyset_page_by_id", """select event_id from events where event_id < 5000 order by event_id desc limit 50""")
def keyset_page_by_id(spark, sf):
    return reporting.keyset_page(roles.events(spark, sf).select("event_id"), ["event_id"], 50, (5000,)).select("event_id")


@register("filtered_event_counts", """select user_id, count(*) n, count(*) filter (where event_type = 'error') errors,
 count(*) filter (where value > 50) high from events group by 1""")
def filtered_event_counts(spark, sf):
    return roles.events(spark, sf).groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("high"))


@register("batch_progress", """with p as (select l_orderkey job_id, l_linenumber - 1 chunk_index, l_returnflag <> 'R' embedded from lineitem),
 j as (select o_orderkey job_id, 1 + o_orderkey % 7 total_items from orders), d as (select job_id, count(*) n,
   count(*) filter (where not embedded) m, max(chunk_index // 16) b from p group by 1)
select job_id, total_items, coalesce(n, 0) processed_items, coalesce(m, 0) missing_embeddings, b last_batch,
 case when coalesce(n, 0) = total_items and coalesce(m, 0) = 0 then 'complete' else 'ingestion_incomplete' end status_code from j left join d using (job_id)""")
def batch_progress(spark, sf):
    p = read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), (F.col("l_linenumber") - 1).alias("chunk_index"), (F.col("l_returnflag") != "R").alias("embedded"))
    j = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (1 + F.col("o_orderkey") % 7).alias("total_items"))
    return reporting.ingestion_progress(j, p).select("job_id", "total_items", "processed_items", "missing_embeddings", "last_batch", "status_code")


LOG_SQL = """log as (select ts, user_id % 25 institution_id, value * 7000 - 20000 duration_ms,
 case event_type when 'purchase' then 'supported' when 'error' then 'error' else 'insufficient_sources' end result,
 case when event_type = 'error' then 'generation_failed' end error_code, event_id % 6 passages_used, (event_id % 100) / 100.0 similarity,
 case when event_id % 10 = 0 then 'x' else json_extract_string(props, '$.k') end prompt_tokens, cast(value as varchar) completion_tokens from events)"""


def request_log(spark, sf):
    e = roles.events(spark, sf)
    return e.select(
        "ts", (F.col("user_id") % 25).alias("institution_id"), (F.col("value") * 7000 - 20000).alias("duration_ms"),
        F.when(F.col("event_type") == "purchase", "supported").when(F.col("event_type") == "error", "error").otherwise("insufficient_sources").alias("result"),
        F.when(F.col("event_type") == "error", "generation_failed").alias("error_code"), (F.col("event_id") % 6).alias("passages_used"),
        ((F.col("event_id") % 100) / 100).alias("similarity"),
        F.when(F.col("event_id") % 10 == 0, "x").otherwise(F.get_json_object("props", "$.k")).alias("prompt_tokens"),
        F.col("value").cast("string").alias("completion_tokens"),
    )


@register("request_log_summary", "with " + LOG_SQL + """
select institution_id, strftime(date_trunc('day', ts), '%Y-%m-%d') log_day, count(*) requests, count(*) filter (where result = 'supported') supported,
 count(*) filter (where result = 'insufficient_sources') insufficient, count(*) filter (where result = 'error') errors,
 count(error_code) with_error_code, sum(greatest(0, least(300000, round(duration_ms)))) duration_ms,
 max(greatest(0, least(300000, round(duration_ms)))) max_duration_ms, cast(sum(passages_used) as bigint) passages_used, round(avg(similarity), 6) mean_similarity
from log group by 1, 2""")
def request_log_summary(spark, sf):
    log = request_log(spark, sf).withColumn("log_day", F.date_format("ts", "yyyy-MM-dd"))
    out = reporting.request_log_summary(log, ["institution_id", "log_day"])
    return out.withColumn("mean_similarity", F.round("mean_similarity", 6)).drop("unclamped_duration_ms")


@register("request_log_durations", "with " + LOG_SQL + """
select institution_id, strftime(date_trunc('day', ts), '%Y-%m-%d') log_day, sum(round(duration_ms)) unclamped_duration_ms from log group by 1, 2""")
def request_log_durations(spark, sf):
    log = request_log(spark, sf).withColumn("log_day", F.date_format("ts", "yyyy-MM-dd"))
    return reporting.request_log_summary(log, ["institution_id", "log_day"]).select("institution_id", "log_day", "unclamped_duration_ms")


@register("token_usage", "with " + LOG_SQL + """, t as (select institution_id, case when try_cast(prompt_tokens as double) between 0 and 10000000
  and try_cast(prompt_tokens as double) = floor(try_cast(prompt_tokens as double)) then try_cast(prompt_tokens as double) else 0 end p,
 case when try_cast(completion_tokens as double) = floor(try_cast(completion_tokens as double)) and try_cast(completion_tokens as double) between 0 and 10000000
  then try_cast(completion_tokens as double) else 0 end c from log)
select institution_id, cast(sum(p) as bigint) prompt_tokens, cast(sum(c) as bigint) completion_tokens, cast(sum(p + c) as bigint) total_tokens from t group by 1""")
def token_usage(spark, sf):
    return reporting.token_usage(request_log(spark, sf), ["institution_id"])


@register("checklist_progress", """with items as (select distinct o_custkey profile, l_partkey item from lineitem join orders on o_orderkey = l_orderkey),
 done as (select distinct o_custkey profile, l_partkey item from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R')
select profile, count(*) items, count(done.item) done, cast(floor(100.0 * count(done.item) / count(*) + 0.5) as bigint) percent
from items left join done using (profile, item) group by 1""")
def checklist_progress(spark, sf):
    line = read_table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"), "l_returnflag")
    o = read_table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("profile"))
    rows = line.join(o, line.l_orderkey == o.o_orderkey).select("profile", "item", "l_returnflag")
    return reporting.checklist_progress(rows.select("profile", "item").distinct(), rows.where("l_returnflag = 'R'"), ["profile"], "item")


@register("constraint_report", """select l_orderkey, l_linenumber, unnest(list_filter([
  case when not (l_quantity between 2 and 49) then 'quantity_range' end, case when not (l_discount <= 0.09) then 'discount_range' end,
  case when not ((l_linestatus = 'F') = (l_returnflag in ('R', 'A'))) then 'status_bundle' end,
  case when not (l_extendedprice >= l_quantity * 900) then 'progress_within_total' end], lambda x: x is not null)) as rule from lineitem""")
def constraint_report(spark, sf):
    c = F.col
    rules = {
        "quantity_range": c("l_quantity").between(2, 49),
        "discount_range": c("l_discount") <= 0.09,
        "status_bundle": (c("l_linestatus") == "F") == c("l_returnflag").isin("R", "A"),
        "progress_within_total": c("l_extendedprice") >= c("l_quantity") * 900,
    }
    return quality.quality_report(read_table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], rules)


@register("duplicate_report", """select o_custkey, o_orderpriority, count(*) copies from orders where o_orderstatus in ('O', 'P') group by 1, 2 having count(*) > 1""")
def duplicate_report(spark, sf):
    o = read_table(spark, sf, "orders")
    return quality.duplicate_report(o, ["o_custkey", "o_orderpriority"], F.col("o_orderstatus").isin("O", "P"))


@register("orphan_report", """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem l where not exists
 (select 1 from part p join supplier s on s.s_suppkey = p.p_partkey % (select count(*) from supplier) where p.p_partkey = l.l_partkey and s.s_suppkey = l.l_suppkey)""")
def orphan_report(spark, sf):
    supplier = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    n = supplier.agg(F.count("*")).scalar()
    part = read_table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % n).alias("l_suppkey"))
    parent = part.join(supplier, "l_suppkey", "left_semi")
    child = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return quality.orphan_report(child, parent, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@register("citation_lookup", """with r as (select o_custkey, list_distinct(list(l_partkey)) ids from lineitem join orders on o_orderkey = l_orderkey group by 1)
select o_custkey, cast(count(*) as bigint) found, cast(sum(p_size) as bigint) total_size from (select o_custkey, unnest(ids) id from r) join part on p_partkey = id group by 1""")
def citation_lookup(spark, sf):
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    asked = line.join(o, line.l_orderkey == o.o_orderkey).select("o_custkey", "l_partkey").distinct()
    part = read_table(spark, sf, "part").select("p_partkey", "p_size")
    found = lookup_ids(asked.withColumn("ids", F.array("l_partkey")).drop("l_partkey"), "ids", part, "p_partkey")
    return found.groupBy("o_custkey").agg(F.count("*").alias("found"), F.sum("p_size").alias("total_size"))


@register("published_scopes", """select distinct p_type service_id, p_brand job_id, cast(p_size as bigint) unit_id from part where p_size < 10
 union select distinct l_returnflag, l_linestatus, cast(l_linenumber as bigint) from lineitem where l_quantity > 20
 union select distinct c_mktsegment, null, cast(c_nationkey as bigint) from customer""")
def published_scopes(spark, sf):
    from agoradesk.operators.onboarding import published_scope

    part = read_table(spark, sf, "part").where("p_size < 10").select(F.col("p_type").alias("service_id"), F.col("p_brand").alias("job_id"), F.col("p_size").cast("long").alias("unit_id"))
    line = read_table(spark, sf, "lineitem").where("l_quantity > 20").select(F.col("l_returnflag").alias("service_id"), F.col("l_linestatus").alias("job_id"), F.col("l_linenumber").cast("long").alias("unit_id"))
    cust = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("service_id"), F.lit(None).cast("string").alias("job_id"), F.col("c_nationkey").cast("long").alias("unit_id"))
    return published_scope(part, line, cust)
