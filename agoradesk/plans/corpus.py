"""Text normalisation and the passage pipeline over the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from agoradesk.functions import text as tx
from agoradesk.functions.regexes import LINE_SPACE, SPACE
from agoradesk.operators import chunking, reporting
from agoradesk.session import spread
from agoradesk.sources.tables import read_table

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = (build, sql)
        return build

    return keep


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_trim(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^[{SPACE}]+|[{SPACE}]+' + chr(92) + 'z')}, '', 'g')"


def sql_collapse(e: str) -> str:
    return sql_trim(f"regexp_replace({e}, {q(f'[{SPACE}]+')}, ' ', 'g')")


def sql_normalize(e: str) -> str:
    out = f"translate({e}, chr(11) || chr(160) || chr(8239), chr(10) || '  ')"
    steps = [
        ("\\r\\n?", "chr(10)"),
        ("[\uf0a7\uf0b7\uf0d8\uf0fc][\uf020 \\t]*", "'• '"),
        ("[ \\t]+", "' '"),
        (f"[{LINE_SPACE}]+(\\n|\\z)", "'\\1'"),
        ("\\n{4,}", "repeat(chr(10), 3)"),
    ]
    for pattern, to in steps:
        out = f"regexp_replace({out}, {q(pattern)}, {to}, 'g')"
    return sql_trim(out)


END = "(?:[^A-Za-z0-9_]|\\z)"
LETTERED = f"regexp_matches(c, {q(chunking.LETTERED)})"
KIND_SQL = f"""case when length(c) not between 3 and 140 or {LETTERED} then null
 when regexp_matches(c, {q('(?i)^(?:titre|chapitre|section|sous-section|partie|livre|annexe|appendice)' + END)}) then 'explicit:1'
 when regexp_matches(c, {q('(?i)^(?:article|art[.]) *[0-9]+(?:[a-z]|(?:[.][0-9]+)*)?' + END)}) then 'article:1'
 when regexp_matches(c, {q(chunking.HIERARCHICAL)}) then 'hierarchical_number:0.99'
 when regexp_matches(c, {q(chunking.NUMBERED)}) and not regexp_matches(c, '[;,]\\z') then 'numbered:0.97'
 when regexp_matches(c, {q(chunking.BARE_NUMBERED)}) and not regexp_matches(regexp_replace(c, '^[0-9]+ +', ''),
   {q('(?i)^(?:(?:l|lorsqu)[' + chr(39) + '’][A-Za-z0-9_]|(?:le|la|les|un|une|des|du|il|elle|ils|elles|ce|cet|cette|ces|lorsque|si)' + END + ')')}) then 'numbered:0.93'
 when regexp_matches(c, {q(chunking.ROMAN)}) and not regexp_matches(c, '[;,]\\z') then 'roman:0.96'
 when length(regexp_replace(c, '\\P{{L}}', '', 'g')) >= 4 and regexp_replace(c, '\\P{{L}}', '', 'g') = upper(regexp_replace(c, '\\P{{L}}', '', 'g'))
   and not regexp_matches(c, '[;,]\\z') then 'uppercase:0.9' end"""

DOCS_SQL = """docs as (select doc_id, 'Règlement ' || doc_id title, doc_id % 2 = 0 paged, (select string_agg(p, chr(10) order by i) from (select i,
   case when doc_id % 2 = 0 and i > 1 and i % 10 = 1 then chr(12) else '' end ||
   case when i % 6 = 1 then 'Article ' || (((i - 1) // 6 + doc_id) % ((len(ls) + 5) // 6) + 1) || ' - ' || left(l, 30) || chr(10) || l
        when i % 6 in (2, 3) then case when i % 6 = 2 then 'a' else 'b' end || ') ' || l
        when i % 12 = 5 then upper(replace(left(l, 20), 'ß', 's')) || chr(10) || l else l end p
   from (select unnest(ls) l, unnest(range(1, len(ls) + 1)) i))) body
  from (select doc_id, string_split(replace(text, '. ', '.' || chr(10)), chr(10)) ls from documents))"""


def structured(spark, sf):
    """Documents with the headings, lettered items and page breaks of a regulation."""
    d = spread(read_table(spark, sf, "documents")).select("doc_id", F.split(F.replace("text", F.lit(". "), F.lit(".\n")), "\n").alias("ls"))
    paged = F.col("doc_id") % 2 == 0

    def line(v, i):
        sections = F.floor((F.size("ls") + 5) / 6)
        number = (F.floor(i / 6) + F.col("doc_id")) % sections + 1
        head = F.concat(F.lit("Article "), number.cast("string"), F.lit(" - "), F.left(v, F.lit(30)), F.lit("\n"), v)
        item = F.concat(F.when(i % 6 == 1, "a").otherwise("b"), F.lit(") "), v)
        loud = F.concat(F.upper(F.replace(F.left(v, F.lit(20)), F.lit("ß"), F.lit("s"))), F.lit("\n"), v)
        shaped = F.when(i % 6 == 0, head).when((i % 6).isin(1, 2), item).when(i % 12 == 4, loud).otherwise(v)
        return F.concat(F.when(paged & (i > 0) & (i % 10 == 0), "\f").otherwise(""), shaped)

    return d.select("doc_id", F.concat(F.lit("Règlement "), "doc_id").alias("title"), F.array_join(F.transform("ls", line), "\n").alias("text"), paged.alias("paged"))


def chunks(spark, sf):
    return chunking.chunk_documents(structured(spark, sf), ["doc_id"], paged=F.col("paged"))


def last_sql(sep: str) -> str:
    e = "'" + sep[::-1].replace("\n", "' || chr(10) || '") + "'"
    return f"case when strpos(r, {e}) > 0 and length(r) - strpos(r, {e}) - {len(sep)} + 1 >= 2480 then length(r) - strpos(r, {e}) - {len(sep)} + 1 end"


CHUNK_SQL = "with recursive " + DOCS_SQL + f""",
pages as (select doc_id, title, paged, case when paged then i end page, i - 1 raw_seg, {sql_normalize('p')} st from (select doc_id, title, paged,
   unnest(case when paged then string_split(body, chr(12)) else [body] end) p, unnest(range(1, len(case when paged then string_split(body, chr(12)) else [body] end) + 1)) i from docs)),
segs as (select *, row_number() over (partition by doc_id order by raw_seg) - 1 seg from pages where st <> ''),
fits as (select doc_id from pages group by 1 having (not bool_or(paged) or count(*) <= 250) and sum(length(st)) <= 1500000),
lines as (select *, {sql_collapse('line')} c from (select doc_id, seg, unnest(string_split(st, chr(10))) line, unnest(range(1, len(string_split(st, chr(10))) + 1)) ln from segs)),
kinds as (select *, {KIND_SQL} k from lines),
nblocks as (select *, sum(case when k is not null then 1 else 0 end) over (partition by doc_id, seg order by ln) b from kinds),
blocks0 as (select doc_id, seg, b, {sql_trim("string_agg(case when k is not null then " + sql_trim('line') + " else line end, chr(10) order by ln)")} txt,
   max(case when k is not null then c end) head, max(split_part(k, ':', 1)) kind, max(cast(split_part(k, ':', 2) as double)) conf from nblocks group by 1, 2, 3),
blocks as (select *, row_number() over (partition by doc_id, seg order by b) - 1 src from blocks0 where txt <> ''),
seqs as (select *, case kind when 'article' then 'a' when 'explicit' then 'e' when 'numbered' then 'n' end fam,
   try_cast(nullif(case kind when 'article' then regexp_extract(head, {q('(?i)^(?:article|art[.]) *([0-9]+)' + END)}, 1)
    when 'explicit' then regexp_extract(head, {q('(?i)^(?:titre|chapitre|section|partie|livre|annexe|appendice) +([0-9]+)' + END)}, 1)
    when 'numbered' then regexp_extract(head, {q('^([0-9]+)(?: *[-–—.)] +| +' + chr(92) + 'p{Lu})')}, 1) end, '') as bigint) num from blocks),
fam1 as (select doc_id, seg, arg_min(fam, src) f from seqs where num > 0 group by 1, 2),
starts as (select s.*, case when num > 0 and fam = f then num end startnum from seqs s left join fam1 using (doc_id, seg)),
sect as (select *, count(startnum) over (partition by doc_id, seg order by src) sec from starts),
sect2 as (select *, max(startnum) over (partition by doc_id, seg, sec) secnum, lag(startnum ignore nulls) over (partition by doc_id, seg order by src) prevnum from sect),
ok as (select doc_id, seg, count(startnum) >= 3 and count(distinct startnum) = count(startnum) and max(startnum) - min(startnum) + 1 = count(startnum)
    and bool_or(startnum < prevnum) ok from sect2 group by 1, 2),
ordered as (select s.*, coalesce(ok.ok, false) and not d.paged re from sect2 s left join ok using (doc_id, seg) join (select doc_id, paged from docs) d using (doc_id)),
blines as (select doc_id, seg, src, unnest(string_split(txt, chr(10))) line, unnest(range(1, len(string_split(txt, chr(10))) + 1)) ln from ordered),
items as (select doc_id, seg, src, line, ln, ln > 1 and length(c) >= 3 and {LETTERED} item from (select *, {sql_collapse('line')} c from blines)),
fr as (select *, sum(case when item then 1 else 0 end) over (partition by doc_id, seg, src order by ln) f from items),
frags as (select doc_id, seg, src, f, {sql_trim('string_agg(line, chr(10) order by ln)')} txt, max(f) over (partition by doc_id, seg, src) > 0 many from fr group by doc_id, seg, src, f),
placed as (select fg.doc_id, fg.seg, fg.src, fg.txt, case when many then fg.f end frag, o.head, o.kind, o.conf,
   row_number() over (partition by fg.doc_id, fg.seg order by case when re and sec > 0 then secnum else 0 end, fg.src, fg.f) - 1 n
   from frags fg join ordered o on o.doc_id = fg.doc_id and o.seg = fg.seg and o.src = fg.src),
carried as (select *, last_value(head ignore nulls) over w chead, last_value(kind ignore nulls) over w ckind, last_value(conf ignore nulls) over w cconf
   from placed window w as (partition by doc_id order by seg, n rows between unbounded preceding and current row)),
kept as (select * from carried where head is null or {sql_collapse('txt')} <> head),
wins as (select doc_id, seg, n, txt, 0 w, 0 s, case when length(txt) <= 4000 then length(txt) else coalesce(
     (select coalesce({', '.join(last_sql(b) for b in tx.BREAKS)}) + 1 from (select reverse(substring(txt, 1, 4000)) r)), 4000) end e from kept
  union all select doc_id, seg, n, txt, w + 1, s2, case when s2 + 4000 < length(txt) then s2 + coalesce(
     (select coalesce({', '.join(last_sql(b) for b in tx.BREAKS)}) + 1 from (select reverse(substring(txt, s2 + 1, 4000)) r)), 4000) else length(txt) end
   from (select *, greatest(s + 1, e - 500) + length(substring(txt, greatest(s + 1, e - 500) + 1)) - length(regexp_replace(substring(txt, greatest(s + 1, e - 500) + 1), {q(f'^[{SPACE}]+')}, '')) s2
     from wins where e < length(txt)) where s2 < length(txt)),
cut as (select w.*, {sql_trim('substring(w.txt, s + 1, e - s)')} content, k.src, k.frag, k.head, k.chead, k.ckind, k.cconf from wins w join kept k using (doc_id, seg, n)),
numbered as (select *, row_number() over (partition by doc_id order by seg, n, w) - 1 chunk_index, row_number() over (partition by doc_id, seg, n order by w) - 1 bw,
   count(*) over (partition by doc_id) total from cut where content <> ''),
passages as (select m.doc_id, chunk_index, content, cast(greatest(1, ceil(strlen(content) / 4.0)) as bigint) token_count, p.page page_start, chead section_title,
   nullif(left({sql_trim(f"regexp_extract(content, {q(tx.ARTICLE)}, 0)")}, 160), '') article_reference,
   p.title || ' — ' || case when p.page is not null then 'page ' || p.page else 'passage ' || (chunk_index + 1) end source_reference,
   m.seg extraction_segment_index, src extraction_structural_block_index, n normalized_structural_block_index, bw extraction_block_chunk_index,
   case when bw > 0 then 500 else 0 end overlap_characters, src <> n structural_order_normalized, frag list_fragment_index,
   case when head is not null then 'detected' when chead is not null then 'carried' else 'none' end section_heading_source, ckind section_heading_kind, cconf section_heading_confidence
   from numbered m join segs p on p.doc_id = m.doc_id and p.seg = m.seg)"""

META = ("extraction_segment_index", "extraction_structural_block_index", "normalized_structural_block_index", "extraction_block_chunk_index",
        "overlap_characters", "structural_order_normalized", "list_fragment_index", "section_heading_source", "section_heading_kind", "section_heading_confidence")


@register("document_passages", CHUNK_SQL + " select doc_id, chunk_index, sha256(content) content_sha256, token_count, page_start, section_title, article_reference, source_reference, "
          + ", ".join(META) + " from passages")
def document_passages(spark, sf):
    rows = chunking.passage_rows(chunks(spark, sf), ["doc_id"])
    return rows.select("doc_id", "chunk_index", "content_sha256", "token_count", "page_start", "section_title", "article_reference", "source_reference",
                       *[F.col("metadata")[m].alias(m) for m in META])


@register("chunk_pipeline_stats", CHUNK_SQL + """ select doc_id, count(*) passages, cast(sum(length(content)) as bigint) characters, cast(sum(token_count) as bigint) tokens,
 bool_or(structural_order_normalized) any_reordered from passages group by 1""")
def chunk_pipeline_stats(spark, sf):
    return reporting.corpus_stats(chunks(spark, sf), "doc_id")


@register("chunk_status", CHUNK_SQL + """, c as (select doc_id, count(*) n from passages group by 1)
 select d.doc_id, coalesce(n, 0) passage_count, case when p.t is null then 'no_usable_text' when f.doc_id is null then 'document_too_large' when coalesce(n, 0) = 0 then 'no_passages'
   when n > 800 then 'too_many_passages' else 'ok' end chunk_status
 from docs d left join c using (doc_id) left join fits f using (doc_id) left join (select doc_id, sum(length(st)) t from pages where st <> '' group by 1) p using (doc_id)""")
def chunk_status(spark, sf):
    return chunking.chunk_status(structured(spark, sf), ["doc_id"], paged=F.col("paged")).select("doc_id", "passage_count", "chunk_status")


RAW_SQL = """raw as (select doc_id, source, replace(replace(text, ' la ', chr(160) || 'la  '), ' en ', chr(13) || chr(10) || chr(8239) || 'en ' || chr(9)) || '   ' || repeat(chr(10), 5) || ' x ' body from documents)"""


def raw(spark, sf):
    d = read_table(spark, sf, "documents")
    body = F.replace(F.replace("text", F.lit(" la "), F.lit(" la  ")), F.lit(" en "), F.lit("\r\n en \t"))
    return d.select("doc_id", "source", F.concat(body, F.lit("   \n\n\n\n\n x ")).alias("body"))


@register("normalized_text", "with " + RAW_SQL + f" select doc_id, length(t) characters, sha256(t) text_sha256 from (select doc_id, {sql_normalize('body')} t from raw)")
def normalized_text(spark, sf):
    t = raw(spark, sf).select("doc_id", tx.normalize_text(F.col("body")).alias("t"))
    return t.select("doc_id", F.length("t").alias("characters"), F.sha2("t", 256).alias("text_sha256"))


@register("folded_text", f"select doc_id, sha256(lower({sql_collapse('strip_accents(text)')})) folded_sha256 from documents")
def folded_text(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", F.sha2(tx.fold(F.col("text")), 256).alias("folded_sha256"))


@register("comparable_words", r"select doc_id, len(w) words, len(list_distinct(w)) distinct_words from (select doc_id, regexp_extract_all(lower(strip_accents(text)), '\p{L}+') w from documents)")
def comparable_words(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"))


@register("heading_lines", f"""select doc_id, split_part(k, ':', 1) kind, count(*) headings from (select doc_id, {KIND_SQL} k from (select doc_id, {sql_collapse('line')} c
 from (select doc_id, unnest(string_split(body, chr(10))) line from ({DOCS_SQL.replace('docs as (', '', 1)[:-1]})))) where k is not null group by 1, 2""")
def heading_lines(spark, sf):
    lines = structured(spark, sf).select("doc_id", F.explode(F.transform(F.split("text", "\n"), chunking.detect_heading)).alias("h"))
    return lines.where("h is not null").groupBy("doc_id", F.col("h.kind").alias("kind")).agg(F.count("*").alias("headings"))


@register("duplicate_documents", """select source, sha256(text) sha, count(*) copies, min(doc_id) survivor from documents group by 1, 2 having count(*) > 1""")
def duplicate_documents(spark, sf):
    d = read_table(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha"))
    return chunking.duplicate_content(d, "source", "sha", "doc_id")


@register("file_names", r"""select doc_id, case when s = '' then 'document' else s end || case when doc_id % 2 = 0 then '.pdf' else '.docx' end slug from (select doc_id,
 left(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 100) s from documents)""")
def file_names(spark, sf):
    d = read_table(spark, sf, "documents")
    name = F.concat(F.lit("dossier/"), F.translate("text", "/\\", "--"), F.when(F.col("doc_id") % 2 == 0, ".PDF").otherwise(".docx"))
    return d.select("doc_id", tx.slug(name).alias("slug"))


@register("strict_dates", r"""select o_orderkey, strftime(try_cast(case when regexp_matches(s, '^\d{4}-\d{2}-\d{2}$') then s end as date), '%Y-%m-%d') effective_date from
 (select o_orderkey, strftime(o_orderdate, '%Y') || '-' || lpad(cast(1 + o_orderkey % 13 as varchar), 2, '0') || '-' || case when o_orderkey % 5 = 0 then cast(o_orderkey % 32 as varchar)
   else lpad(cast(o_orderkey % 33 as varchar), 2, '0') end s from orders)""")
def strict_dates(spark, sf):
    o = read_table(spark, sf, "orders")
    k = F.col("o_orderkey")
    day = F.when(k % 5 == 0, (k % 32).cast("string")).otherwise(F.lpad((k % 33).cast("string"), 2, "0"))
    s = F.concat_ws("-", F.date_format("o_orderdate", "yyyy"), F.lpad((1 + k % 13).cast("string"), 2, "0"), day)
    return o.select("o_orderkey", tx.strict_date(s).cast("string").alias("effective_date"))


@register("codes_and_labels", r"""select event_id, upper(regexp_replace(' ' || event_type || '-' || event_id || ' x', '[\s-]', '', 'g')) code,
 case event_id % 3 when 0 then 'g' || event_id when 1 then event_type else cast(user_id as varchar) end group_label from events""")
def codes_and_labels(spark, sf):
    e = read_table(spark, sf, "events")
    code = F.concat(F.lit(" "), "event_type", F.lit("-"), F.col("event_id").cast("string"), F.lit(" x"))
    group = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"g'), F.col("event_id").cast("string"), F.lit('"')))
        .when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_type").alias("label"), F.col("user_id").alias("id"))))
        .otherwise(F.to_json(F.struct(F.col("user_id").alias("group_id"))))
    )
    return e.select("event_id", tx.clean_code(code).alias("code"), tx.group_label(group).alias("group_label"))
