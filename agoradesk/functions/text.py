"""Text normalisation as native columns, with an exact Unicode path where Spark has none."""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from agoradesk.functions.columns import let
from agoradesk.functions.regexes import LINE_SPACE, SPACE, SPACE_CHARS

NON_ASCII = "[^\\x00-\\x7F]"


def js_trim(col: Column) -> Column:
    """Trim every kind of white space, looking at the ends only."""
    return F.btrim(col, F.lit(SPACE_CHARS))


def collapse(col: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    blanks = F.translate(col, SPACE_CHARS[1:], " " * (len(SPACE_CHARS) - 1))
    return F.btrim(F.regexp_replace(blanks, " {2,}", " "))


@functools.cache
def _base_letters(form: str) -> tuple[str, str]:
    """Every BMP character that decomposes to exactly one base character, by rule."""
    keep, base = [], []
    for point in range(0xA0, 0xFFFE):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xF8FF:
            continue
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize(form, char) if not unicodedata.category(c).startswith("M"))
        if len(plain) == 1 and plain != char:
            keep.append(char)
            base.append(plain)
    return "".join(keep), "".join(base)


# Compatibility characters that decompose to several characters
# and occur in ordinary office text.
EXPANSIONS = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
    "Ĳ": "IJ", "ĳ": "ij", "…": "...", "‥": "..", "™": "TM", "№": "No",
    "¼": "1⁄4", "½": "1⁄2", "¾": "3⁄4", "⅓": "1⁄3", "⅔": "2⁄3",
}


def _expand(col: Column) -> Column:
    out = col
    for char, text in EXPANSIONS.items():
        out = F.replace(out, F.lit(char), F.lit(text))
    return F.when(col.rlike(f"[{''.join(EXPANSIONS)}]"), out).otherwise(col)


def strip_marks(col: Column, form: str = "NFKD") -> Column:
    """Base letters only. Latin, Greek, Cyrillic and full-width text is covered natively."""
    source, target = _base_letters(form)
    plain = F.regexp_replace(F.translate(col, source, target), "\\p{M}", "")
    if form == "NFKD":
        plain = _expand(plain)
    return F.when(col.rlike(NON_ASCII), plain).otherwise(col)


# Characters up to U+02FF and of general punctuation: none is a mark, and those that stand for several are among EXPANSIONS.
_FAR = "[^\\x00-\\u02FF\\u2000-\\u206F]"
_COMMON = [*range(0x300), *range(0x2000, 0x2070)]
_APOSTROPHES = "’`´"


#: Stands in translated text for a common character that becomes several. It is not a common one itself.
_SEVERAL = "\uffff"


@functools.cache
def _folding() -> tuple[str, str]:
    """Common characters and their comparison form: base letter, straight apostrophe, plain space."""
    base = dict(zip(*_base_letters("NFKD")))
    last = dict.fromkeys(_APOSTROPHES, "'") | dict.fromkeys(SPACE_CHARS[1:], " ")
    form = {c: last.get(base.get(c, c), base.get(c, c)) for c in map(chr, _COMMON)} | {c: _SEVERAL for c in EXPANSIONS if ord(c) in _COMMON}
    changed = [c for c in form if form[c] != c]
    return "".join(changed), "".join(form[c] for c in changed)


def _folded(col: Column, common: Column) -> Column:
    exact = collapse(F.translate(strip_marks(col), _APOSTROPHES, "'" * len(_APOSTROPHES)))
    single = F.when(F.contains(common, F.lit("  ")), F.regexp_replace(common, " {2,}", " ")).otherwise(common)
    # Neither the sign for several characters nor a far one is ASCII, and lengths are quicker to compare than patterns to find.
    rare = (F.octet_length(common) != F.length(common)) & (F.contains(common, F.lit(_SEVERAL)) | col.rlike(_FAR))
    return F.lower(F.when(rare, exact).otherwise(F.btrim(single)))


def fold(col: Column) -> Column:
    """Comparison form of a question: no accents, straight apostrophes, single spaces, lower case."""
    return let(F.translate(col, *_folding()), lambda common: _folded(col, common))


def with_folded(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``fold(text)`` as a column. It takes two projections, which are compiled; inside one expression ``let`` would be interpreted."""
    common = df.withColumn("_common", F.translate(F.col(text), *_folding()))
    return common.withColumn(name, _folded(F.col(text), F.col("_common"))).drop("_common")


@F.pandas_udf(StringType())
def fold_exact(texts: pd.Series) -> pd.Series:
    """As ``fold`` for scripts the native table leaves alone (Hangul, ideograph variants)."""

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.category(c).startswith("M"))
        for mark in "’`´":
            plain = plain.replace(mark, "'")
        return " ".join(plain.split()).lower()

    return texts.map(one)


def comparable(col: Column) -> Column:
    """Canonical base letters in lower case; spaces and ligatures stay."""
    return F.lower(strip_marks(col, "NFD"))


def words(col: Column) -> Column:
    return F.regexp_extract_all(comparable(col), F.lit("\\p{L}+"), F.lit(0))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def nfkc(col: Column) -> Column:
    """NFKC; text made of letters that are already composed never reaches Python."""
    composed = col.rlike("^[\\x00-\\x9F¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃ–—‘-„†-•‰‹›€]*\\z")
    return F.when(composed, col).otherwise(_nfkc(F.when(~composed, col)))


def normalize_newlines(col: Column) -> Column:
    return F.regexp_replace(col, "\\r\\n?", "\n")


def normalize_text(col: Column) -> Column:
    """Extracted text in the form every later step assumes."""
    out = F.translate(col, "\u000b\u00a0\u202f\u0000", "\n  ")
    out = normalize_newlines(out)
    out = F.regexp_replace(out, "[\uf0a7\uf0b7\uf0d8\uf0fc][\uf020 \\t]*", "• ")
    out = F.regexp_replace(out, "[ \\t]+", " ")
    out = F.regexp_replace(out, f"[{LINE_SPACE}]+(\\n|\\z)", "$1")
    out = F.regexp_replace(out, "\\n{4,}", "\n\n\n")
    return js_trim(out)


def token_estimate(col: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.octet_length(col) / 4))


# Fixed value: an article reference at the start of a line.
ARTICLE = f"(?im)^(?:article|art\\.)[{SPACE}]*[0-9]+(?:[a-z]|(?:\\.[0-9]+)*)?(?:[{SPACE}]*[-–—:][^\\n]{{0,120}})?"


def article_ref(col: Column) -> Column:
    found = F.regexp_extract(col, ARTICLE, 0)
    return F.when(found != "", F.left(js_trim(found), F.lit(160)))


def source_reference(title: Column, page_start: Column, page_end: Column, chunk_index: Column) -> Column:
    clean = F.left(js_trim(title), F.lit(250))
    pages = F.when(
        page_end.isNotNull() & (page_end != page_start),
        F.concat(F.lit("pages "), page_start.cast("string"), F.lit("–"), page_end.cast("string")),
    ).otherwise(F.concat(F.lit("page "), page_start.cast("string")))
    place = F.when(page_start.isNotNull(), pages).otherwise(
        F.concat(F.lit("passage "), (chunk_index + 1).cast("string"))
    )
    return F.left(F.concat(clean, F.lit(" — "), place), F.lit(500))


def slug(col: Column) -> Column:
    """Storage-safe file name that keeps its .pdf or .docx ending."""
    base = F.regexp_extract(col, "[^\\\\/]*\\z", 0)
    extension = F.when(F.lower(base).endswith(".pdf"), F.lit(".pdf")).otherwise(F.lit(".docx"))
    stem = F.regexp_replace(base, "(?i)\\.(pdf|docx)\\z", "")
    plain = F.regexp_replace(F.lower(strip_marks(stem)), "[^a-z0-9]+", "-")
    plain = F.left(F.regexp_replace(plain, "^-+|-+\\z", ""), F.lit(100))
    return F.concat(F.when(plain == "", F.lit("document")).otherwise(plain), extension)


def strict_date(col: Column) -> Column:
    """A calendar date written exactly YYYY-MM-DD, else null."""
    return F.when(col.rlike("^\\d{4}-\\d{2}-\\d{2}\\z"), F.try_to_date(col, "yyyy-MM-dd"))


def clean_code(col: Column) -> Column:
    return F.regexp_replace(F.upper(js_trim(col)), f"[{SPACE}-]", "")


def group_label(json_text: Column) -> Column:
    """Label of a suggested group: a bare value, else the first naming field, else the object."""
    bare = F.regexp_extract(json_text, "^\\s*\"?([^{\"]*)\"?\\s*$", 1)
    named = F.coalesce(
        *[F.get_json_object(json_text, f"$.{k}") for k in ("name", "label", "group_name", "id", "group_id")]
    )
    return F.left(F.when(json_text.rlike("^\\s*\\{"), F.coalesce(named, json_text)).otherwise(bare), F.lit(150))


def last_index(backwards: Column, size: Column, mark: str) -> Column:
    """0-based position of the last ``mark`` in a text given reversed; -1 when absent."""
    pos = F.locate(mark[::-1], backwards)
    return F.when(pos > 0, size - pos - len(mark) + 1).otherwise(F.lit(-1))


# Passage size, overlap, earliest cut and cut preference.
TARGET, OVERLAP, EARLIEST = 4_000, 500, 2_480
BREAKS = ("\n\n", "\n", ". ", "; ", ", ", " ")


def split_windows(text: Column, target: int = TARGET, overlap: int = OVERLAP, earliest: int = EARLIEST) -> Column:
    """Overlapping windows cut at the best break, as an array of trimmed texts.

    Each start depends on the previous end, so the walk is a fold over as many
    steps as the text can need; a text within the target never enters it.
    """
    size = F.length(text)
    gain = earliest + 1 - overlap
    steps = F.sequence(F.lit(1), F.ceil(size / gain).cast("int") + 1)
    start_state = F.struct(
        F.lit(0).alias("start"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("out")
    )

    def advance(acc: Column, _: Column) -> Column:
        hard = F.least(acc["start"] + target, size)

        def cut(backwards: Column) -> Column:
            width = hard - acc["start"]
            breaks = [let(last_index(backwards, width, b), lambda i: F.when(i >= earliest, i)) for b in BREAKS]
            return F.when(hard < size, F.coalesce(acc["start"] + F.coalesce(*breaks) + 1, hard)).otherwise(hard)

        def emit(end: Column) -> Column:
            resume = F.greatest(acc["start"] + 1, end - overlap)
            solid = F.lit(f"[^{SPACE}]")
            near = F.regexp_instr(F.substring(text, resume + 1, F.lit(64)), solid)
            far = F.regexp_instr(F.substring(text, resume + 1, size), solid)
            offset = let(near, lambda n: F.when(n > 0, n).otherwise(far))
            piece = js_trim(F.substring(text, acc["start"] + 1, end - acc["start"]))
            return F.struct(
                let(offset, lambda o: F.when(o > 0, resume + o - 1).otherwise(size)).cast("int").alias("start"),
                (end >= size).alias("done"),
                let(
                    piece,
                    lambda p: F.when(p == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(p))),
                ).alias("out"),
            )

        step = let(let(F.reverse(F.substring(text, acc["start"] + 1, F.lit(target))), cut), emit)
        return F.when(acc["done"] | (acc["start"] >= size), acc).otherwise(step)

    walked = F.aggregate(steps, start_state, advance, lambda acc: acc["out"])
    return F.when(size <= target, F.array(js_trim(text))).otherwise(walked)
