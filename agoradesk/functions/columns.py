"""Small column builders: binding, clamping, parsing, identifiers, time buckets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from agoradesk.functions.regexes import UUID


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def first_match(*cases: tuple[Column, str], default: str | None = None) -> Column:
    """Ordered cascade: the code of the first true condition."""
    out = None
    for cond, code in cases:
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out.otherwise(F.lit(default))


def labelled(col: Column, labels: Mapping[str, object], default: object = None) -> Column:
    """Look a code up in a short fixed table."""
    out = None
    for key, label in labels.items():
        cond = col == F.lit(key)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default))


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def clamp(col: Column, low: object, high: object) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def is_uuid(col: Column) -> Column:
    return F.coalesce(col.rlike(f"(?i)^{UUID}\\z"), F.lit(False))


def parse_decimal_comma(col: Column) -> Column:
    return F.replace(col, F.lit(","), F.lit(".")).try_cast("double")


def safe_token(col: Column) -> Column:
    """Token counters as logged by a model: whole, 0 to ten million, else 0."""
    value = col.try_cast("double")
    ok = (value == F.floor(value)) & value.between(0, 10_000_000)
    return F.when(ok, value.cast("long")).otherwise(F.lit(0).cast("long"))


def epoch_bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned window of ``seconds`` holding ``ts``."""
    return F.window(ts, f"{seconds} seconds").start


def micros(ts: Column) -> Column:
    """Microseconds since the epoch for timestamps with or without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def uuid_from(*parts: Column) -> Column:
    """A repeatable v5-shaped identifier, so a lost task recomputes the same one."""
    digest = F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lit("a"), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def plural(count: Column, word: str) -> Column:
    return F.concat(F.lit(word), F.when(count > 1, F.lit("s")).otherwise(F.lit("")))


#: From here on every double is a whole number; the casts of smaller ones cannot overflow.
WHOLE = 2.0**53


def number_text(col: Column) -> Column:
    """A number as people write it: plain decimals, no exponent and no trailing zeros. Doubles of any size have one."""
    value = col.cast("double")
    small = F.when(F.abs(value) < WHOLE, value)
    plain = F.regexp_replace(small.cast("decimal(38,15)").cast("string"), "0+$", "")
    text = F.when(value == F.floor(value), small.cast("long").cast("string")).otherwise(plain)
    return F.when(F.abs(value) >= WHOLE, F.format_string("%.0f", value)).otherwise(text)


def compare(left: Column, comparator: Column, right: Column) -> Column:
    """Apply a comparator held in a column; null when either side is null."""
    return (
        F.when(comparator == "=", left == right)
        .when(comparator == "!=", left != right)
        .when(comparator == "<", left < right)
        .when(comparator == "<=", left <= right)
        .when(comparator == ">", left > right)
        .when(comparator == ">=", left >= right)
    )
