"""Turn extracted text into numbered, citable passages.

A document is one bounded row (longer ones get a status instead), so the whole
walk from text to passages stays inside that row: lines are marked, cut on the
marks and exploded once at the end. No shuffle is needed at any corpus size and
no source, tenant or group of copies can become a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.functions.columns import let
from agoradesk.functions.regexes import NOT_WORD_AFTER, SPACE
from agoradesk.functions.text import (
    OVERLAP,
    TARGET,
    article_ref,
    collapse,
    js_trim,
    normalize_text,
    source_reference,
    split_windows,
    token_estimate,
)

# Document limits.
MAX_PAGES = 250
MAX_CHARACTERS = 1_500_000
MAX_PASSAGES = 800
TOKEN_METHOD = "estimated_utf8_bytes_div_4"

# Heading shapes. Lines are collapsed before they are tested.
LETTERED = f"^[a-zà-öø-ÿ][{SPACE}]*[-–—.)][{SPACE}]+[^{SPACE}]"
EXPLICIT = f"(?i)^(?:titre|chapitre|section|sous-section|partie|livre|annexe|appendice){NOT_WORD_AFTER}"
ARTICLE_LINE = f"(?i)^(?:article|art\\.) *\\d+(?:[a-z]|(?:\\.\\d+)*)?{NOT_WORD_AFTER}"
HIERARCHICAL = f"^\\d+(?:\\.\\d+){{1,5}} +\\p{{Lu}}[^{SPACE}]*"
NUMBERED = f"^\\d{{1,3}}(?:\\.\\d+){{0,4}} *[-–—.)] +\\p{{Lu}}[^{SPACE}]*"
BARE_NUMBERED = "^\\d{1,3} +(\\p{Lu}[\\p{L}\\d'’ -]*)\\z"
ROMAN = f"^[IVXLCDM]{{1,8}} *[-–—.)] +\\p{{Lu}}[^{SPACE}]*"
ITEM_END = "[;,]\\z"

# Numbering that may be put back in order.
SEQUENCES = (
    ("article", "article", f"(?i)^(?:article|art\\.) *(\\d+){NOT_WORD_AFTER}"),
    (
        "explicit",
        "explicit_number",
        f"(?i)^(?:titre|chapitre|section|partie|livre|annexe|appendice) +(\\d+){NOT_WORD_AFTER}",
    ),
    ("numbered", "numbered", "^(\\d+)(?: *[-–—.)] +| +\\p{Lu})"),
)

_HEADING = "struct<title:string,kind:string,confidence:double>"
_BLOCK = f"struct<text:string,heading:{_HEADING},source_index:int>"
_MARK = "\u0000"


def _starts_like_sentence(text: Column) -> Column:
    # An elided article ends in an apostrophe, so what must follow it is a letter
    # or digit; a whole word must end there.
    elided = text.rlike("(?i)^(?:l['’]|lorsqu['’])[A-Za-z0-9_]")
    whole = text.rlike(f"(?i)^(?:le|la|les|un|une|des|du|il|elle|ils|elles|ce|cet|cette|ces|lorsque|si){NOT_WORD_AFTER}")
    return elided | whole


def _shape(line: Column) -> Column:
    ends_item = line.rlike(ITEM_END)
    rest = F.regexp_extract(line, BARE_NUMBERED, 1)
    letters = F.regexp_replace(line, "\\P{L}", "")

    def heading(kind: str, confidence: float) -> Column:
        return F.struct(line.alias("title"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))

    shaped = (
        F.when(line.rlike(EXPLICIT), heading("explicit", 1.0))
        .when(line.rlike(ARTICLE_LINE), heading("article", 1.0))
        .when(line.rlike(HIERARCHICAL), heading("hierarchical_number", 0.99))
        .when(line.rlike(NUMBERED) & ~ends_item, heading("numbered", 0.97))
        .when((rest != "") & ~_starts_like_sentence(rest), heading("numbered", 0.93))
        .when(line.rlike(ROMAN) & ~ends_item, heading("roman", 0.96))
        .when((F.length(letters) >= 4) & (letters == F.upper(letters)) & ~ends_item, heading("uppercase", 0.9))
    )
    fits = F.length(line).between(3, 140) & ~line.rlike(LETTERED)
    return F.when(fits, shaped).cast(_HEADING)


def detect_heading(line: Column) -> Column:
    """Title, kind and confidence of a heading line, or null."""
    return let(collapse(line), _shape)


def is_list_item(line: Column) -> Column:
    """A lettered clause such as ``c) …`` of any length."""
    return let(collapse(line), lambda v: (F.length(v) >= 3) & v.rlike(LETTERED))


def _marked(text: Column, test, clean) -> Column:
    lines = F.split(text, "\\r?\\n")
    return F.array_join(F.transform(lines, lambda v, i: F.when(test(v, i), F.concat(F.lit(_MARK), clean(v))).otherwise(v)), "\n")


def blocks(text: Column) -> Column:
    """Structural blocks of a segment: each heading line opens one, blank ones are dropped."""
    parts = F.split(_marked(text, lambda v, _: detect_heading(v).isNotNull(), js_trim), _MARK)
    shaped = F.transform(
        parts,
        lambda p, i: F.struct(
            js_trim(p).alias("text"),
            F.when(i > 0, detect_heading(F.substring_index(p, "\n", 1))).alias("heading"),
        ),
    )
    kept = F.filter(shaped, lambda b: b["text"] != "")
    return F.transform(
        kept,
        lambda b, i: F.struct(b["text"].alias("text"), b["heading"].alias("heading"), i.cast("int").alias("source_index")),
    ).cast(f"array<{_BLOCK}>")


def list_fragments(text: Column) -> Column:
    """Texts of a block cut before every lettered item after its first line."""
    parts = F.split(_marked(text, lambda v, i: (i > 0) & is_list_item(v), lambda v: v), _MARK)
    return F.transform(parts, js_trim)


def _sequence(heading: Column) -> Column:
    family, number = None, None
    for kind, name, pattern in SEQUENCES:
        cond = heading["kind"] == kind
        digits = F.regexp_extract(heading["title"], pattern, 1)
        value = F.when(F.length(digits) <= 15, digits.try_cast("long"))
        family = F.when(cond, F.lit(name)) if family is None else family.when(cond, F.lit(name))
        number = F.when(cond, value) if number is None else number.when(cond, value)
    return let(number, lambda n: F.when(n > 0, F.struct(family.alias("family"), n.alias("number"))))


def reorder_sections(block_list: Column) -> Column:
    """Put shuffled numbered sections back in order, only when the numbering is beyond doubt."""

    def with_sequence(items: Column) -> Column:
        return F.transform(items, lambda b: _sequence(b["heading"]))

    def decide(seqs: Column) -> Column:
        family = F.element_at(F.filter(seqs, lambda s: s.isNotNull()), 1)["family"]
        places = F.transform(
            seqs,
            lambda s, i: F.when(
                s["family"] == family, F.struct(s["number"].alias("number"), i.cast("int").alias("at"))
            ),
        )
        return let(F.filter(places, lambda p: p.isNotNull()), arrange)

    def arrange(starts: Column) -> Column:
        numbers = F.transform(starts, lambda s: s["number"])
        consecutive = (F.array_max(numbers) - F.array_min(numbers) + 1) == F.size(numbers)
        unique = F.size(F.array_distinct(numbers)) == F.size(numbers)
        shuffled = numbers != F.array_sort(numbers)
        spans = F.transform(
            starts,
            lambda s, k: F.struct(
                s["number"].alias("number"),
                s["at"].alias("at"),
                F.coalesce(F.get(starts, k + 1)["at"], F.size(block_list)).alias("until"),
            ),
        )
        ordered = F.flatten(
            F.concat(
                F.array(F.slice(block_list, 1, F.get(starts, F.lit(0))["at"])),
                F.transform(F.array_sort(spans), lambda s: F.slice(block_list, s["at"] + 1, s["until"] - s["at"])),
            )
        )
        usable = (F.size(starts) >= 3) & unique & consecutive & shuffled
        return F.when(usable, ordered).otherwise(block_list)

    return F.coalesce(let(with_sequence(block_list), decide), block_list)


def segments(docs: DataFrame, text: str = "text", paged: Column | None = None) -> DataFrame:
    """Add ``segments``, ``character_count`` and ``extraction_status``.

    Paged text is cut on form feeds and numbered from 1, empty pages are
    skipped; other text is one segment without page numbers.
    """
    is_paged = F.lit(False) if paged is None else paged
    kind = "array<struct<text:string,page_start:int,page_end:int>>"
    pages = F.transform(
        F.split(F.col(text), "\f"),
        lambda p, i: F.struct(
            normalize_text(p).alias("text"), (i + 1).cast("int").alias("page_start"), (i + 1).cast("int").alias("page_end")
        ),
    ).cast(kind)
    whole = F.array(
        F.struct(
            normalize_text(F.col(text)).alias("text"),
            F.lit(None).cast("int").alias("page_start"),
            F.lit(None).cast("int").alias("page_end"),
        )
    ).cast(kind)
    raw = F.when(is_paged, pages).otherwise(whole)
    page_count = F.when(is_paged, F.size(F.split(F.col(text), "\f")))
    found = docs.withColumn("page_count", page_count).withColumn("segments", F.filter(raw, lambda s: s["text"] != ""))
    total = F.aggregate("segments", F.lit(0).cast("long"), lambda acc, s: acc + F.length(s["text"]))
    counted = found.withColumn("character_count", total)
    status = (
        F.when(F.col("page_count") > MAX_PAGES, "document_too_large")
        .when(F.col("character_count") > MAX_CHARACTERS, "document_too_large")
        .when(F.size("segments") == 0, "no_usable_text")
        .otherwise("ok")
    )
    return counted.withColumn("extraction_status", status)


def document_passages(docs: DataFrame, title: str = "title", unpaged: Column | None = None) -> DataFrame:
    """Add the ordered ``passages`` array and ``chunk_status`` to documents that have ``segments``."""
    natural = F.transform("segments", lambda s: blocks(s["text"]))
    if unpaged is not None:
        natural = F.transform(natural, lambda b: F.when(unpaged, reorder_sections(b)).otherwise(b))
    in_blocks = docs.withColumn(
        "_blocks", F.when(F.col("extraction_status") != "no_usable_text", natural).otherwise(F.array().cast(f"array<array<{_BLOCK}>>"))
    )
    last_heading = F.transform(
        "_blocks",
        lambda bs: let(
            F.filter(F.transform(bs, lambda b: b["heading"]), lambda h: h.isNotNull()),
            lambda hs: F.when(F.size(hs) > 0, F.element_at(hs, -1)),
        ),
    )
    carried = in_blocks.withColumn("_last", last_heading)

    def carry_into(i: Column) -> Column:
        before = F.filter(F.slice("_last", F.lit(1), i), lambda h: h.isNotNull())
        return let(before, lambda hs: F.when(F.size(hs) > 0, F.element_at(hs, -1)))

    def fragments_of(b: Column) -> Column:
        return let(
            list_fragments(b["text"]),
            lambda parts: F.transform(
                parts,
                lambda t, k: F.struct(
                    t.alias("text"),
                    b["heading"].alias("heading"),
                    b["source_index"].alias("source_index"),
                    F.when(F.size(parts) > 1, k.cast("int")).alias("fragment"),
                ),
            ),
        )

    def passages_of(segment: Column, i: Column) -> Column:
        pieces = F.flatten(F.transform(F.get(F.col("_blocks"), i), fragments_of))
        numbered = F.transform(pieces, lambda p, n: F.struct(p.alias("p"), n.cast("int").alias("n")))
        # Headings occur in every block but possibly the first, whose heading comes
        # from an earlier segment.
        kept = F.filter(
            numbered,
            lambda q: ~F.coalesce(collapse(q["p"]["text"]) == q["p"]["heading"]["title"], F.lit(False)),
        )

        def windows(q: Column) -> Column:
            p = q["p"]
            current = F.coalesce(p["heading"], F.get(F.col("_carry"), i))
            return F.transform(
                split_windows(p["text"]),
                lambda content, w: F.struct(
                    content.alias("content"),
                    segment["page_start"].alias("page_start"),
                    segment["page_end"].alias("page_end"),
                    current["title"].alias("section_title"),
                    F.struct(
                        i.cast("int").alias("extraction_segment_index"),
                        p["source_index"].alias("extraction_structural_block_index"),
                        q["n"].alias("normalized_structural_block_index"),
                        w.cast("int").alias("extraction_block_chunk_index"),
                        F.length(content).alias("character_count"),
                        F.lit(TOKEN_METHOD).alias("token_count_method"),
                        F.when(w > 0, F.lit(OVERLAP)).otherwise(F.lit(0)).alias("overlap_characters"),
                        (p["source_index"] != q["n"]).alias("structural_order_normalized"),
                        p["fragment"].alias("list_fragment_index"),
                        F.when(p["heading"].isNotNull(), "detected")
                        .when(current.isNotNull(), "carried")
                        .otherwise("none")
                        .alias("section_heading_source"),
                        current["kind"].alias("section_heading_kind"),
                        current["confidence"].alias("section_heading_confidence"),
                    ).alias("metadata"),
                ),
            )

        return F.flatten(F.transform(kept, windows))

    built = (
        carried.withColumn("_carry", F.transform("_last", lambda _, i: carry_into(i)))
        .withColumn("passages", F.flatten(F.transform("segments", passages_of)))
        .drop("_blocks", "_last", "_carry")
    )
    status = (
        F.when(F.col("extraction_status") != "ok", F.col("extraction_status"))
        .when(F.size("passages") == 0, "no_passages")
        .when(F.size("passages") > MAX_PASSAGES, "too_many_passages")
        .otherwise("ok")
    )
    return built.withColumn("chunk_status", status)


def chunk_documents(
    docs: DataFrame,
    keys: list[str],
    title: str = "title",
    text: str = "text",
    paged: Column | None = None,
) -> DataFrame:
    """One row per passage of every document, whatever its length; ``chunk_status`` reports the long ones beside it."""
    unpaged = F.lit(True) if paged is None else ~paged
    built = document_passages(segments(docs, text, paged), title, unpaged)
    # An outer explode, because a filter on the passages would be pushed below the
    # projection that builds them and build them a second time.
    kept = F.when(F.size("passages") > 0, F.col("passages"))
    rows = built.select(*keys, title, F.posexplode_outer(kept).alias("chunk_index", "p")).where("chunk_index is not null")
    page = F.col("p")
    return rows.select(
        *keys,
        "chunk_index",
        page["content"].alias("content"),
        token_estimate(page["content"]).cast("int").alias("token_count"),
        page["page_start"].alias("page_start"),
        page["page_end"].alias("page_end"),
        page["section_title"].alias("section_title"),
        article_ref(page["content"]).alias("article_reference"),
        source_reference(F.col(title), page["page_start"], page["page_end"], F.col("chunk_index")).alias("source_reference"),
        page["metadata"].alias("metadata"),
    )


def chunk_status(docs: DataFrame, keys: list[str], title: str = "title", text: str = "text", paged: Column | None = None) -> DataFrame:
    """Outcome per document: ok, no_usable_text, document_too_large, no_passages, too_many_passages."""
    unpaged = F.lit(True) if paged is None else ~paged
    built = document_passages(segments(docs, text, paged), title, unpaged)
    return built.select(*keys, "character_count", F.size("passages").alias("passage_count"), "chunk_status")


def embedding_backlog(passages: DataFrame, tenant: str, doc: str, batch: int = 16) -> DataFrame:
    """Passages without a vector, in batches of 16 per document, in storage order.

    Numbering restarts with each document, whose passages are bounded.
    """
    w = Window.partitionBy(tenant, doc).orderBy("chunk_index")
    waiting = passages.where("embedding is null")
    return waiting.withColumn("batch", F.floor((F.row_number().over(w) - 1) / batch))


def passage_rows(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Passages as stored: with their content hash, counted once per document by ``chunk_index``."""
    return chunks.select(*keys, "chunk_index", "content", F.sha2("content", 256).alias("content_sha256"),
                         *[c for c in chunks.columns if c not in {*keys, "chunk_index", "content"}])


def duplicate_content(df: DataFrame, tenant: str, sha: str, key: str) -> DataFrame:
    """Groups of equal content within a tenant, with the smallest id as survivor."""
    return (
        df.groupBy(tenant, sha)
        .agg(F.count("*").alias("copies"), F.min(key).alias("survivor"))
        .where("copies > 1")
    )


__all__ = [
    "TARGET", "OVERLAP", "MAX_PAGES", "MAX_CHARACTERS", "MAX_PASSAGES", "detect_heading", "is_list_item", "blocks",
    "list_fragments", "reorder_sections", "segments", "document_passages", "chunk_documents", "chunk_status",
    "passage_rows", "embedding_backlog", "duplicate_content",
]
