"""Values in words, as columns: amounts, shares, times, identifiers, and addresses found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short(value: Column, head: int = 6, tail: int = 4) -> Column:
    """A long identifier with its middle left out."""
    return F.when(F.char_length(value) <= head + tail + 1, value).otherwise(F.concat(F.substring(value, 1, head), F.lit("…"), F.right(value, F.lit(tail))))


def percent(share: Column) -> Column:
    """A whole percent that is never rounded to none or all."""
    whole = F.bround(share * 100, 0).cast("long")
    return (
        F.when(share <= 0, "0%").when(share >= 1, "100%").when(whole < 1, "under 1%").when(whole > 99, "over 99%").otherwise(F.concat(whole.cast("string"), F.lit("%")))
    )


def probability(p: Column) -> Column:
    return F.when(p > 0.99, "over 0.99").when(p < 0.01, "under 0.01").otherwise(F.format_number(p, 2))


def duration(seconds: Column) -> Column:
    """A time span in its largest unit."""
    out = F.lit(None).cast("string")
    for name, size in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400)):
        n = F.bround(seconds / size, 0).cast("long")
        text = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        out = F.when(seconds >= size, text).otherwise(F.lit("0 seconds") if size == 1 else out)
    return out


def indian_groups(number: Column) -> Column:
    """12,34,567: the last three digits, then pairs."""
    text = number.cast("long").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\d)(\d{3})$", "$1,$2"), r"(\d)(?=(\d\d)+,)", "$1,")


def plain_decimal(value: Column) -> Column:
    """Decimal text without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def cell(value: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(value.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def qualify(chain: Column, address: Column, home: str) -> Column:
    return F.when(chain == home, address).otherwise(F.concat_ws(":", chain, address))


#: An address is a run of letters and digits of some length with both in it.
ADDRESS = r"\b[A-Za-z]+[0-9][A-Za-z0-9]{6,}\b"


def addresses(text: Column, pattern: str = ADDRESS) -> Column:
    """All matches in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def interval(confidence: Column, n: Column) -> tuple[Column, Column]:
    """A confidence with its spread, which is never under .02 nor over .45."""
    spread = F.least(F.greatest(1.96 * F.sqrt(F.greatest(confidence * (1 - confidence), F.lit(1e-4)) / n), F.lit(0.02)), F.lit(0.45))
    return F.round(F.greatest(confidence - spread, F.lit(0.0)), 4), F.round(F.least(confidence + spread, F.lit(1.0)), 4)


def case_id(key: Column) -> Column:
    return F.concat(F.lit("c-"), F.substring(F.sha2(key.cast("binary"), 256), 1, 10))
