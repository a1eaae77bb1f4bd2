"""PII: bootstrapped contextual extraction.

1. Seeds: addresses, numbers and phones found by fixed patterns. Other strings with a digit or an at sign are candidates.
2. Every mention has lexical patterns: the word before it, the word after it, its shape, and its form (the shape with the lengths of
   its runs of digits).
3. Patterns and instances are judged in turn over the corpus: a pattern by the seeds and accepted instances it holds against the
   strings that speak against it, an instance by its patterns.
4. A candidate with a confident context and a confident shape or form of one kind, or between two confident contexts of one kind, is
   accepted. Accepted instances count like seeds in the next round, so that their forms and contexts become patterns themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.shared import boxed, join_by_document, tidy, write_stage

# Kinds in their order, and the patterns of the seeds.
KINDS = ("email", "ip", "card", "phone")
EMAIL_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a run of digits is tried once, from its first digit
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Words with a digit or an at sign; tried from the first sign of a word only, so that a text without blanks takes linear time.
CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*(?:\x20[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*)*")
SIGN = re.compile("[0-9@]")
EDGE = "\"'`.,;:!?()[]{}<>|*#&$%="
#: A candidate has at least so many letters and digits.
LEAST_SIGNS = 7
#: Rounds of scoring after that of the seeds; seeds and accepted instances a pattern needs; score from which a pattern, and a discovered instance, is confident.
ROUNDS, SUPPORT, PATTERN_SCORE, INSTANCE_SCORE = 3, 5, 0.8, 0.9

MENTION = "struct<kind:string,start:int,end:int,instance:string,patterns:array<string>>"
BASE = f"doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string, mentions array<{MENTION}>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each at sign back over name characters, then on over the host."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in EMAIL_NAME:
            start -= 1
        host = EMAIL_HOST.match(text, at) if start < at else None
        if host:
            free = host.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def is_part(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    significant = digits.lstrip("0")
    return len(significant) < 4 and int(significant or "0") <= 255


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base matches, by start and then by kind."""
    out = []
    if "@" in text:
        out += [("email", a, z) for a, z in emails(text)]
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(is_part(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0]) if m.end() - m.start() >= 12 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def shape(text: str) -> str:
    """Letters as a, digits as 9, runs of either as one; other signs stay."""
    return re.sub(r"9+", "9", re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", text)))


def form(text: str) -> str:
    """Letters as a, digits as 9 and the length of their run, runs of letters as one; other signs stay."""
    return re.sub(r"[^\W\d_]+|[0-9]+", lambda m: f"9{len(m[0])}" if "0" <= m[0][0] <= "9" else "a", text)


def mention(text: str, kind: str | None, start: int, end: int) -> dict:
    before, after = text[max(0, start - 80) : start].split(), text[end : end + 80].split(None, 1)
    patterns = ["shape:" + shape(text[start:end]), "form:" + form(text[start:end])]
    if before and (left := before[-1].lower().strip(EDGE)):
        patterns.append("before:" + left)
    if after and (right := after[0].lower().strip(EDGE)):
        patterns.append("after:" + right)
    return {"kind": kind, "start": start, "end": end, "instance": text[start:end].lower(), "patterns": patterns}


def mentions(text: str) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """(base spans, mentions): every base span and every candidate that touches none, with their patterns."""
    spans = base_spans(text)
    out = [mention(text, *span) for span in spans]
    taken = sorted((a, z) for _, a, z in spans)
    k = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while start < end and text[start] in EDGE and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end or sum(c.isalnum() for c in text[start:end]) < LEAST_SIGNS:
            continue
        out.append(mention(text, None, start, end))
    return spans, out


def find_mentions(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, the spans as text, and all mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))
        for batch in batches:
            counts, base, held = [], [], []
            for text in batch["text"].to_pylist():
                spans, found = mentions(text) if text and SIGN.search(text) else ([], [])
                counts.append([sum(s[0] == k for s in spans) for k in KINDS])
                base.append(",".join(f"{k}:{a}:{z}" for k, a, z in spans))
                held.append(found)
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "text_hash": batch["text_hash"],
                **{f"n_{k}": pa.array([c[i] for c in counts], pa.int64()) for i, k in enumerate(KINDS)},
                "base": pa.array(base, pa.string()), "mentions": pa.array(held, kind),
            })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text")).mapInArrow(tidy(run), BASE)


def discover(base: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, text_hash, kind, start, end) of the candidates that confident patterns find.

    Only patterns that hold ``SUPPORT`` seeds and accepted instances of a kind and have a score of ``PATTERN_SCORE`` speak. A candidate's
    evidence is the scores of its speaking patterns combined as independent; it is accepted from ``INSTANCE_SCORE`` on if a context speaks
    and its shape or form does too, or if the contexts on both sides speak and its form is native to the kind (see :func:`_score`).
    A round reads nothing but the instances accepted before it, so when these did not change, all later rounds would only repeat it.
    """
    each = base.select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.*")
    edges = each.select("instance", "kind", F.col("patterns")[1].alias("form"), F.explode("patterns").alias("pattern"))
    edges = write_stage(edges.groupBy("pattern", "instance").agg(F.max("kind").alias("seed"), F.min("form").alias("form")), "pattern_edges")
    held = write_stage(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("held")), "pattern_sizes")
    spots = write_stage(each.where("kind is null").select("instance", "patterns").distinct(), "spots")
    accepted, n = base.sparkSession.createDataFrame([], "instance string, kind string"), 0
    for _ in range(rounds + 1):
        scored, forms = _score(edges, held, spots, accepted)
        taken = write_stage(_judge(spots, scored, forms), "taken")
        found = taken.groupBy("instance").agg(F.max_by("kind", F.struct("evidence", "kind")).alias("kind"))
        before, accepted = (accepted, n), write_stage(found, "accepted")
        n = accepted.count()
        if n == before[1] and not (n and accepted.join(before[0], ["instance", "kind"], "left_anti").count()):
            break
    best = taken.groupBy("instance", "patterns").agg(F.max_by("kind", F.struct("evidence", "kind")).alias("kind"))
    return each.where("kind is null").drop("kind").join(best, ["instance", "patterns"]).select("doc_id", "text_hash", "kind", "start", "end")


def _is_context(pattern: Column) -> Column:
    return ~(pattern.startswith("shape:") | pattern.startswith("form:"))


def _score(edges: DataFrame, held: DataFrame, spots: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pattern, kind, score) of all patterns that speak, (form, kind) of the native forms).

    A score is the share of a kind's seeds and accepted instances among a pattern's distinct strings, damped by one, without the
    strings that are undecided. A form is native to a kind if at least half of its strings belong to it: if base patterns matched some,
    seeds and accepted ones do (the others failed a check); if they matched none, also those with contexts of the kind on both sides.
    Undecided are, in a context, unseen strings of native forms; in a form without seeds, unseen strings beside a context of the kind.
    """
    unseen = edges.where("seed is null").select("pattern", "instance", "form")
    seeded = edges.where("seed is not null").select("pattern", F.col("seed").alias("kind"), F.lit(1).alias("seeds"))
    late = unseen.join(accepted, "instance").select("pattern", "kind", F.lit(0).alias("seeds"))
    members = seeded.unionAll(late).groupBy("pattern", "kind").agg(F.sum("seeds").alias("seeds"), F.count(F.lit(1)).alias("n"))
    members = write_stage(members, "pattern_members")
    holding = members.where((F.col("n") >= SUPPORT) & _is_context(F.col("pattern"))).select("pattern", "kind")

    around = F.filter("patterns", _is_context)
    sides = spots.join(accepted, "instance", "left_anti").select(
        "instance", "patterns", F.col("patterns")[1].alias("form"), F.size(around).alias("sides"), F.explode(around).alias("pattern"),
    )
    met = sides.join(holding, "pattern").groupBy("instance", "patterns", "form", "sides", "kind").agg(F.count(F.lit(1)).alias("met"))
    near = met.groupBy("instance", "form", "kind").agg(F.max((F.col("met") >= F.least(F.lit(2), "sides")).cast("long")).alias("inside"))
    near = near.groupBy(F.col("form").alias("pattern"), "kind").agg(F.count(F.lit(1)).alias("near"), F.sum("inside").alias("inside"))
    own = members.where(F.col("pattern").startswith("form:")).select("pattern", "kind", "seeds", "n", F.lit(0).alias("near"), F.lit(0).alias("inside"))
    forms = near.select("pattern", "kind", F.lit(0).alias("seeds"), F.lit(0).alias("n"), "near", "inside").unionAll(own)
    forms = forms.groupBy("pattern", "kind").agg(*(F.sum(c).alias(c) for c in ("seeds", "n", "near", "inside"))).join(held, "pattern")
    belong = F.col("n") + F.when(F.col("seeds") > 0, 0).otherwise(F.col("inside"))
    forms = write_stage(forms.select("pattern", "kind", "seeds", "near", (2 * belong >= F.col("held")).alias("native")), "pattern_forms")

    native = forms.where("native").select(F.col("pattern").alias("form"), "kind")
    open_edges = unseen.where(_is_context(F.col("pattern"))).join(accepted, "instance", "left_anti")
    undecided = open_edges.join(holding, "pattern").join(native, ["form", "kind"]).groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("undecided"))
    undecided = undecided.unionAll(forms.where("seeds = 0").select("pattern", "kind", F.col("near").alias("undecided")))
    scored = members.where(F.col("n") >= SUPPORT).join(held, "pattern").join(undecided, ["pattern", "kind"], "left")
    against = F.greatest(F.col("held") - F.coalesce("undecided", F.lit(0)), F.col("n"))
    scored = scored.select("pattern", "kind", (F.col("n") / (against + 1)).alias("score")).where(F.col("score") >= PATTERN_SCORE)
    return write_stage(scored, "pattern_scores"), native


def _judge(spots: DataFrame, scored: DataFrame, native: DataFrame) -> DataFrame:
    """(instance, patterns, kind, evidence) of the spots that are accepted."""
    told = spots.select("instance", "patterns", F.explode("patterns").alias("pattern")).join(scored, "pattern")
    context = _is_context(F.col("pattern"))
    found = told.groupBy("instance", "patterns", "kind").agg(
        (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("evidence"),
        F.sum((~context).cast("int")).alias("shapes"), F.sum(context.cast("int")).alias("contexts"),
    )
    found = found.where((F.col("evidence") >= INSTANCE_SCORE) & (F.col("contexts") > 0)).withColumn("form", F.col("patterns")[1])
    found = found.join(native.withColumn("native", F.lit(True)), ["form", "kind"], "left")
    both = (F.col("contexts") > 1) & F.col("native").isNotNull()
    return found.where((F.col("shapes") > 0) | both).select("instance", "patterns", "kind", "evidence")


def identifier_spans(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, text_hash, n_email, n_ip, n_card, n_phone, base, spans.

    Counts and ``base`` are those of the base patterns; ``spans`` has the discovered spans as well. Both list kind:start:end by start
    and kind, in code points, end exclusive. A null or empty text has none.
    """
    base = write_stage(find_mentions(docs), "mentions")
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    added = discover(base, rounds).groupBy("doc_id", "text_hash").agg(
        F.array_sort(F.collect_set(F.struct("start", order.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("span")))).alias("added")
    )
    added = added.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    joined = base.join(added, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    parts = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.struct(
        F.split(s, ":")[1].cast("int").alias("start"), F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.split(s, ":")[0]).alias("rank"), s.alias("span"),
    ))
    merged = F.array_sort(F.concat(parts, F.coalesce("added", F.array().cast("array<struct<start:int,rank:bigint,span:string>>"))))
    return joined.select(
        "doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base",
        F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.transform(merged, lambda s: s["span"]), ",")).alias("spans"),
    )


def identifier_report(docs: DataFrame) -> DataFrame:
    found = identifier_spans(docs)
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def mask_identifiers(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span in ``text`` replaced by its kind in brackets; spans that overlap become one, named by the first."""
    found = identifier_spans(docs).where("spans <> ''").select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch["row"].field("text").to_pylist()
            texts = pa.array([mask(t, s) if s else t for t, s in zip(old, batch["spans"].to_pylist(), strict=True)], pa.string())
            yield pa.record_batch([texts if n == "text" else batch["row"].field(n) for n in names], names=names)

    return join_by_document(boxed(docs), found).mapInArrow(tidy(run), docs.schema)


def mask(text: str, spans: str) -> str:
    out, at = [], 0
    for kind, a, z in (s.split(":") for s in spans.split(",")):
        start, end = int(a), int(z)
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])

