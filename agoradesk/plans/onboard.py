"""Admissions, document life and onboarding content."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.operators import chat, lifecycle
from agoradesk.operators import onboarding as ob
from agoradesk.plans import roles
from agoradesk.plans.roles import NOW, with_roles
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


DOC_SQL = """docs as (select doc_id document_id, source institution_id, ['draft', 'ready', 'active', 'inactive', 'obsolete', 'error'][1 + doc_id % 6] status, lang || doc_id title,
   case when doc_id % 5 <> 0 then 'unpdf' else ' ' end extraction_method, 's/' || doc_id storage_path, md5(text) sha, 'k' || doc_id % 90 document_key, lang version_label from documents),
 jobs as (select o_orderkey job_id, d.document_id, d.institution_id, case o_orderstatus when 'F' then 'succeeded' when 'O' then 'running' else ['queued', 'failed', 'cancelled'][1 + o_orderkey % 3] end status, o_orderdate created_at,
   o_orderkey % 4 attempt_count, 3 max_attempts, case when o_orderstatus = 'O' then o_orderdate end locked_at from orders join docs d on d.document_id = o_custkey)"""


def doc_tables(spark, sf):
    d = read_table(spark, sf, "documents")
    n = F.col("doc_id")
    states = F.array(*[F.lit(x) for x in ("draft", "ready", "active", "inactive", "obsolete", "error")])
    docs = d.select(
        n.alias("document_id"), F.col("source").alias("institution_id"), F.element_at(states, (1 + n % 6).cast("int")).alias("status"),
        F.concat("lang", n.cast("string")).alias("title"), F.when(n % 5 != 0, "unpdf").otherwise(" ").alias("extraction_method"),
        F.concat(F.lit("s/"), n.cast("string")).alias("storage_path"), F.md5("text").alias("file_sha256"),
        F.concat(F.lit("k"), (n % 90).cast("string")).alias("document_key"), F.col("lang").alias("version_label"))
    o = read_table(spark, sf, "orders")
    other = F.element_at(F.array(*[F.lit(x) for x in ("queued", "failed", "cancelled")]), (1 + F.col("o_orderkey") % 3).cast("int"))
    jobs = o.join(docs.select("document_id", "institution_id"), o.o_custkey == docs.document_id).select(
        F.col("o_orderkey").alias("job_id"), "document_id", "institution_id",
        F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise(other).alias("status"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 4).alias("attempt_count"), F.lit(3).alias("max_attempts"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")).alias("locked_at"))
    return docs, jobs


@register("ingestion_eligibility", "with " + DOC_SQL + """, last as (select * from (select *, row_number() over (partition by document_id order by created_at desc, job_id desc) rn from jobs) where rn = 1)
 select d.document_id, case when d.status in ('ready', 'active') then 'already_ready' when d.status = 'obsolete' then 'document_obsolete' when job_id is null then 'job_not_found' when l.status = 'succeeded' then 'already_ready'
  when l.status = 'cancelled' then 'job_cancelled' when l.status = 'running' and locked_at >= timestamp '2000-01-01' - interval 15 minute then 'already_processing' when attempt_count >= max_attempts then 'retry_exhausted' else 'started' end status_code
 from docs d left join last l using (document_id)""")
def ingestion_eligibility(spark, sf):
    docs, jobs = doc_tables(spark, sf)
    out = lifecycle.classify_ingestion(docs, jobs, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return out.select("document_id", "status_code")


@register("activation_eligibility", "with " + DOC_SQL + """, p as (select vec_id % 150 document_id, count(*) n, count(*) filter (where vec_id % 7 = 0 and label = 3) m from embeddings group by 1)
 select document_id, coalesce(m, 0) missing_embeddings, case when status = 'active' then 'already_active' when status not in ('ready', 'inactive') then 'document_not_ready' when trim(extraction_method) = '' then 'extraction_incomplete'
  when document_id in (select document_id from jobs where status in ('queued', 'running')) then 'ingestion_in_progress' when n is null then 'no_passages' when m > 0 then 'embeddings_incomplete'
  when document_id % 8 = 3 then 'source_file_missing' else 'activated' end status_code from docs left join p using (document_id)""")
def activation_eligibility(spark, sf):
    docs, jobs = doc_tables(spark, sf)
    e = read_table(spark, sf, "embeddings")
    passages = e.select((F.col("vec_id") % 150).alias("document_id"), F.when(~((F.col("vec_id") % 7 == 0) & (F.col("label") == 3)), F.lit(1)).alias("embedding"))
    passages = passages.join(docs.select("document_id", "institution_id"), "document_id")
    files = docs.where("document_id % 8 <> 3").select("storage_path")
    out = lifecycle.classify_activation(docs, jobs, passages, files)
    return out.select("document_id", F.coalesce("missing_embeddings", F.lit(0)).alias("missing_embeddings"), "status_code")


@register("deactivations", "with " + DOC_SQL + " select document_id, case status when 'inactive' then 'already_inactive' when 'active' then 'deactivated' else 'document_not_active' end status_code from docs")
def deactivations(spark, sf):
    return lifecycle.classify_deactivation(doc_tables(spark, sf)[0]).select("document_id", "status_code")


@register("removal_eligibility", "with " + DOC_SQL + """, ruled as (select distinct l_suppkey document_id from lineitem where l_quantity = 50 and l_linenumber = 1),
 req as (select event_id, event_id % (select (max(doc_id) + 1) * 110 // 100 from documents) document_id, event_type <> 'error' confirmed, case when event_id % 2 = 0 then 'x' end t from events)
 select event_id, case when not confirmed then 'confirmation_required' when d.document_id is null then 'document_not_found' when r.document_id in (select document_id from jobs where status in ('queued', 'running')) then 'ingestion_in_progress'
  when r.document_id in (select document_id from ruled) then 'document_has_protected_rules' when d.status = 'active' and coalesce(t, d.title) <> d.title then 'active_confirmation_required' else 'deleted' end status_code
 from req r left join docs d using (document_id)""")
def removal_eligibility(spark, sf):
    docs, jobs = doc_tables(spark, sf)
    titles = docs.select("document_id", "institution_id", F.col("title").alias("_t"))
    e = roles.events(spark, sf).select("event_id", (F.col("event_id") % roles.span(spark, sf, "documents", "doc_id", 110)).alias("document_id"), (F.col("event_type") != "error").alias("confirmed"))
    req = e.join(titles, "document_id", "left").withColumn("confirmation_title", F.when(F.col("event_id") % 2 == 0, "x").otherwise(F.col("_t"))).drop("_t")
    sets = read_table(spark, sf, "lineitem").where("l_quantity = 50 and l_linenumber = 1").select(F.col("l_suppkey").alias("document_id"), F.lit("approved").alias("status"))
    sets = sets.join(docs.select("document_id", "institution_id"), "document_id")
    return lifecycle.classify_removal(req, docs, jobs, sets).select("event_id", "status_code")


@register("upload_admission", "with " + DOC_SQL + """, u as (select doc_id u, doc_id % (select (max(doc_id) + 1) * 40 // 100 from documents) document_id, source institution_id, md5(case when doc_id % 3 = 0 then text else lang || doc_id % (select (max(doc_id) + 1) * 25 // 100 from documents) end) sha, 'k' || (doc_id * 7) % (select (max(doc_id) + 1) * 50 // 100 from documents) document_key,
   case when doc_id % 2 = 0 then lang else 'v2' end version_label, n_chars from documents),
 e as (select u.*, case when u % 11 = 0 then 'invalid_storage_path' when u % 13 = 0 then 'source_file_missing' when u % 17 = 0 then 'source_metadata_mismatch'
   when exists (select 1 from docs d where d.institution_id = u.institution_id and d.sha = u.sha and d.document_id % 2 = 0) then 'duplicate_file'
   when exists (select 1 from docs d where d.institution_id = u.institution_id and d.document_key = u.document_key and d.version_label = u.version_label and d.document_id % 2 = 0) then 'version_already_exists' end early from u),
 f as (select *, min(case when early is null then u end) over (partition by institution_id, sha) ff from e),
 v as (select *, min(case when early is null and u = ff then u end) over (partition by institution_id, document_key, version_label) fv from f)
 select u, coalesce(early, case when u <> ff then 'duplicate_file' when u <> fv then 'version_already_exists' else 'registered' end) status_code from v""")
def upload_admission(spark, sf):
    docs = doc_tables(spark, sf)[0].where("document_id % 2 = 0")
    d = read_table(spark, sf, "documents")
    n = F.col("doc_id")
    doc = (n % roles.span(spark, sf, "documents", "doc_id", 40)).cast("string")
    path = F.concat_ws("/", F.when(n % 11 == 0, "elsewhere").otherwise(F.col("source")), doc, F.concat(F.lit("f"), n.cast("string")))
    up = d.select(
        n.alias("u"), (n % roles.span(spark, sf, "documents", "doc_id", 40)).alias("document_id"), F.col("source").alias("institution_id"), path.alias("storage_path"), F.col("n_chars").alias("size_bytes"),
        F.lit("application/pdf").alias("mime_type"),
        F.md5(F.when(n % 3 == 0, F.col("text")).otherwise(F.concat("lang", (n % roles.span(spark, sf, "documents", "doc_id", 25)).cast("string")))).alias("file_sha256"),
        F.concat(F.lit("k"), (n * 7 % roles.span(spark, sf, "documents", "doc_id", 50)).cast("string")).alias("document_key"), F.when(n % 2 == 0, F.col("lang")).otherwise("v2").alias("version_label"))
    files = up.where("u % 13 <> 0").select("storage_path", F.when(F.col("u") % 17 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"), "mime_type")
    return lifecycle.classify_uploads(up, docs, files, ["u"]).select("u", "status_code")


MSG_SQL = with_roles("users", "devices", "memberships", "channels") + """,
 msgs as (select event_id message_id, ts, (event_id * 3) % (select (max(o_orderkey) + 1) * 102 // 100 from orders) device_id, case when event_id % 50 = 0 then '' else 'brand' || (1 + event_id % 27) end channel_id, case when event_id % 41 = 0 then '' when event_id % 43 = 0 then repeat('x', 4001) else event_type end body from events),
 checked as (select m.*, d.user_id, u.institution_id, case when length(m.channel_id) < 1 then 'invalid_channel' when length(body) < 1 then 'empty_message' when length(body) > 4000 then 'message_too_long' when d.device_id is null then 'device_unknown'
  when d.revoked_at is not null then 'device_revoked' when d.activated_at is null or d.user_id is null then 'device_not_activated' when u.user_id is null then 'user_unknown' when not u.active then 'user_inactive'
  when c.enabled is null then 'channel_unknown' when not c.enabled then 'channel_disabled' when b.user_id is null then 'channel_access_denied' else 'ok' end check_code
  from msgs m left join devices d using (device_id) left join users u on u.user_id = d.user_id left join channels c on c.institution_id = u.institution_id and c.channel_id = m.channel_id
  left join memberships b on b.user_id = d.user_id and b.institution_id = u.institution_id and b.channel_id = m.channel_id)"""


def checked_messages(spark, sf):
    e = roles.events(spark, sf)
    n = F.col("event_id")
    msgs = e.select(
        n.alias("message_id"), "ts", (n * 3 % roles.span(spark, sf, "orders", "o_orderkey", 102)).alias("device_id"),
        F.when(n % 50 == 0, " ").otherwise(F.concat(F.lit("Brand"), (1 + n % 27).cast("string"))).alias("channel_id"),
        F.when(n % 41 == 0, " ").when(n % 43 == 0, F.repeat(F.lit("x"), 4001)).otherwise(F.col("event_type")).alias("body"),
        F.lit(None).cast("long").alias("reply_to"), F.lit(True).alias("reply_ok"))
    return chat.classify_messages(msgs, roles.devices(spark, sf), roles.users(spark, sf), roles.channels(spark, sf), roles.memberships(spark, sf))


@register("message_checks", MSG_SQL + " select message_id, check_code from checked")
def message_checks(spark, sf):
    return checked_messages(spark, sf).select("message_id", "check_code")


@register("message_admission", MSG_SQL + """, ok as (select * from checked where check_code = 'ok')
 select message_id, case when check_code <> 'ok' then check_code when exists (select 1 from ok o where o.user_id = c.user_id and o.channel_id = c.channel_id and o.body = c.body and o.message_id < c.message_id and o.ts >= c.ts - interval 3 second) then 'duplicate_suppressed' else 'success' end status_code from checked c""")
def message_admission(spark, sf):
    return chat.admit_messages(checked_messages(spark, sf), "ts").select("message_id", "status_code")


@register("action_checks", with_roles("users", "devices", "memberships", "channels") + """,
 m as (select conv_id * 10 + turn message_id, conv_id % 25 institution_id, 'brand' || (1 + turn % 3) channel_id, (conv_id * 37) % 1500 author_id, text body, turn % 5 = 4 deleted, turn = 1 pinned from conversations),
 a as (select o_orderkey action_id, o_orderkey device_id, ['edit', 'delete', 'pin', 'unpin'][1 + o_orderkey % 4] act, (o_orderkey % (select (max(conv_id) + 1) * 100 // 100 from conversations)) * 10 + o_orderkey % 6 message_id, case when o_orderkey % 8 = 2 then '2h' else '4h' end duration from orders),
 open_m as (select mb.* from memberships mb join channels c using (institution_id, channel_id) where c.enabled)
 select action_id, case when act = 'pin' and duration <> '4h' then 'invalid_duration' when d.revoked_at is not null then 'device_revoked' when d.activated_at is null or d.user_id is null then 'device_not_activated' when u.user_id is null then 'user_unknown' when not u.active then 'user_inactive'
  when act in ('pin', 'unpin') then 'cadre_required' when m.message_id is null then 'message_not_found' when m.author_id <> d.user_id then 'not_message_author' when act = 'delete' and m.deleted then 'already_deleted' when act = 'edit' and m.deleted then 'message_deleted'
  when o.user_id is null then 'channel_access_denied' else 'success' end status_code
 from a join devices d using (device_id) left join users u on u.user_id = d.user_id left join m on m.message_id = a.message_id and m.institution_id = u.institution_id left join open_m o on o.user_id = d.user_id and o.institution_id = u.institution_id and o.channel_id = m.channel_id""")
def action_checks(spark, sf):
    c = read_table(spark, sf, "conversations")
    messages = c.select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("message_id"), (F.col("conv_id") % 25).alias("institution_id"),
        F.concat(F.lit("brand"), (1 + F.col("turn") % 3).cast("string")).alias("channel_id"), (F.col("conv_id") * 37 % 1500).alias("author_id"),
        F.col("text").alias("body"), (F.col("turn") % 5 == 4).alias("deleted"), (F.col("turn") == 1).alias("pinned"))
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    acts = F.array(*[F.lit(x) for x in ("edit", "delete", "pin", "unpin")])
    actions = o.select(k.alias("action_id"), k.alias("device_id"), F.element_at(acts, (1 + k % 4).cast("int")).alias("action"), (k % roles.span(spark, sf, "conversations", "conv_id", 100) * 10 + k % 6).alias("message_id"),
                       F.lit("neuf").alias("body"), F.when(k % 8 == 2, "2h").otherwise("4h").alias("duration"))
    out = chat.classify_actions(actions, messages, roles.devices(spark, sf), roles.users(spark, sf), roles.channels(spark, sf), roles.memberships(spark, sf))
    return out.select("action_id", "status_code")


CONTENT_SQL = """content as (select doc_id item_id, substr(source, 1, 5) institution_id, ['draft', 'published', 'archived'][1 + doc_id % 3] status, doc_id % 10 <> 1 active, case when doc_id % 4 <> 0 then lang end audience,
   case when doc_id % 5 <> 0 then doc_id % 7 end service_id, case when doc_id % 6 = 1 then doc_id % 3 end job_id, case when doc_id % 8 = 1 then doc_id % 2 end unit_id,
   ['welcome', 'schedule', 'note'][1 + doc_id % 3] block_type, text body, doc_id % 50 display_order from documents),
 pub as (select * from content where status = 'published' and active)"""


def content(spark, sf):
    d = read_table(spark, sf, "documents")
    n = F.col("doc_id")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + n % len(xs)).cast("int"))
    return d.select(
        n.alias("item_id"), F.substring("source", 1, 5).alias("institution_id"), pick("draft", "published", "archived").alias("status"), (n % 10 != 1).alias("active"),
        F.when(n % 4 != 0, F.col("lang")).alias("audience"), F.when(n % 5 != 0, n % 7).alias("service_id"), F.when(n % 6 == 1, n % 3).alias("job_id"),
        F.when(n % 8 == 1, n % 2).alias("unit_id"), pick("welcome", "schedule", "note").alias("block_type"), F.col("text").alias("body"), (n % 50).alias("display_order"))


@register("published_content", "with " + CONTENT_SQL + " select item_id from pub where audience is null or audience = 'fr'")
def published_content(spark, sf):
    return ob.published(content(spark, sf), "fr").select("item_id")


@register("referenced_services", "with " + CONTENT_SQL + """, sv as (select distinct c_custkey % 9 service_id, c_custkey % 9 <> 4 active from customer), jb as (select distinct c_custkey % 5 job_id, c_custkey % 9 service_id, c_custkey % 4 <> 0 active from customer)
 select 'service' kind, service_id, null::bigint job_id from sv where active and service_id in (select service_id from pub) union all
 select 'job', service_id, job_id from jb where active and job_id in (select job_id from pub) and service_id in (select service_id from sv where active)""")
def referenced_services(spark, sf):
    scope = ob.published_scope(ob.published(content(spark, sf)))
    c = read_table(spark, sf, "customer")
    k = F.col("c_custkey")
    services = c.select((k % 9).alias("service_id"), (k % 9 != 4).alias("active")).distinct()
    jobs = c.select((k % 5).alias("job_id"), (k % 9).alias("service_id"), (k % 4 != 0).alias("active")).distinct()
    s = ob.referenced_dims(services, scope, "service_id").select(F.lit("service").alias("kind"), "service_id", F.lit(None).cast("long").alias("job_id"))
    j = ob.referenced_dims(jobs, scope, "job_id", services).select(F.lit("job").alias("kind"), "service_id", "job_id")
    return s.unionByName(j)


@register("masked_contacts", """select c_custkey, case when c_custkey % 2 = 0 then c_name end phone, case when c_custkey % 3 = 0 then c_mktsegment end email, c_custkey % 5 = 0 or c_custkey % 7 = 0 available from customer""")
def masked_contacts(spark, sf):
    k = F.col("c_custkey")
    c = read_table(spark, sf, "customer").select(
        k, F.col("c_name").alias("phone"), F.col("c_mktsegment").alias("email"), (k % 2 == 0).alias("phone_validated"), (k % 3 == 0).alias("email_validated"),
        F.when(k % 5 == 0, "path").alias("storage_path"), F.when(k % 7 == 0, "url").alias("external_url"))
    return ob.document_availability(ob.mask_contacts(c)).select("c_custkey", "phone", "email", "available")


PROFILE_SQL = "profiles as (select c_custkey profile_id, 'src' || (c_custkey % 20) src, case when c_custkey % 9 <> 0 then c_custkey % 8 end service_id, case when c_custkey % 3 <> 0 then c_custkey % 3 end job_id, case when c_custkey % 2 = 0 then c_custkey % 2 end unit_id from customer)"


def profiles(spark, sf):
    k = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(
        k.alias("profile_id"), F.when(k % 9 != 0, k % 8).alias("service_id"), F.when(k % 3 != 0, k % 3).alias("job_id"), F.when(k % 2 == 0, k % 2).alias("unit_id"))


@register("items_for_profiles", "with " + CONTENT_SQL + "," + PROFILE_SQL + """ select profile_id, count(*) items, cast(sum(item_id) as bigint) id_sum from profiles p join pub i on (i.service_id is null or i.service_id = p.service_id)
 and (i.job_id is null or i.job_id = p.job_id) and (i.unit_id is null or i.unit_id = p.unit_id) where i.item_id % 20 = p.profile_id % 20 group by 1""")
def items_for_profiles(spark, sf):
    items = ob.published(content(spark, sf)).select("item_id", "service_id", "job_id", "unit_id", (F.col("item_id") % 20).alias("tenant"))
    people = profiles(spark, sf).withColumn("tenant", F.col("profile_id") % 20)
    seen = ob.items_for_profiles(items, people, "tenant")
    return seen.groupBy("profile_id").agg(F.count("*").alias("items"), F.sum("item_id").alias("id_sum"))


@register("profile_states", "with " + PROFILE_SQL + """ select profile_id, case when service_id is null or service_id > 6 then 'service_required' when service_id % 2 = 0 and job_id is null then 'job_required' when service_id % 3 = 0 and unit_id is null then 'unit_required' else 'ready' end profile_state from profiles""")
def profile_states(spark, sf):
    s = read_table(spark, sf, "customer").select((F.col("c_custkey") % 7).alias("service_id")).distinct()
    out = ob.profile_state(profiles(spark, sf), s, s.where("service_id % 2 = 0"), s.where("service_id % 3 = 0"))
    return out.select("profile_id", "profile_state")


@register("content_sections", "with " + CONTENT_SQL + " select case block_type when 'welcome' then 'welcome' when 'schedule' then 'info' else 'content' end section, count(*) items from content group by 1")
def content_sections(spark, sf):
    return content(spark, sf).groupBy(ob.content_section(F.col("block_type")).alias("section")).agg(F.count("*").alias("items"))


@register("faq_search", "select doc_id item_id from documents where contains(lower(lang || ' ' || text || ' ' || source), 'the')")
def faq_search(spark, sf):
    f = read_table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("question"), F.col("text").alias("answer"), F.col("source").alias("category"))
    return ob.faq_search(f, " THE ").select("item_id")


@register("onboarding_bundle", "with " + CONTENT_SQL + """ select institution_id, coalesce(audience, '*') audience, case block_type when 'welcome' then 'content' when 'schedule' then 'info' else 'faq' end section,
  lpad(cast(display_order as varchar), 4, '0') || '|' || lpad(cast(item_id as varchar), 12, '0') sort_key, '{"item_id":' || item_id || ',"display_order":' || display_order || '}' item from pub""")
def onboarding_bundle(spark, sf):
    rows = ob.published(content(spark, sf)).select(
        "institution_id", F.coalesce("audience", F.lit("*")).alias("audience"), "item_id", "display_order", "block_type",
        F.concat_ws("|", F.lpad(F.col("display_order").cast("string"), 4, "0"), F.lpad(F.col("item_id").cast("string"), 12, "0")).alias("sort_key"))
    parts = {s: rows.where(F.col("block_type") == b).drop("block_type") for s, b in (("content", "welcome"), ("info", "schedule"), ("faq", "note"))}
    return ob.bundle_rows(parts, ["institution_id", "audience"])
