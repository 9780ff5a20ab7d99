"""Expressions that turn raw text fields into typed values, null where they cannot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadgauge.functions.columns import ColumnLike, as_column

# The whitespace stripped before parsing, accepted number form, date
# patterns (UTC), and the limit above which a number already is milliseconds.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ISO_ZONED = "yyyy-M-d'T'H:m:s'Z'"
ISO = "yyyy-M-d'T'H:m:s"
DASHES = "yyyy-M-d H:m:s"
SLASHES = "yyyy/M/d H:m:s"
MILLISECONDS_ABOVE = 1_000_000_000_000
TRUE_WORDS = ["true", "1", "yes"]
FALSE_WORDS = ["false", "0", "no"]


def stripped(text: ColumnLike) -> Column:
    return F.btrim(as_column(text).cast("string"), F.lit(SPACE))


def _moment(text: Column) -> Column:
    # The appended zone makes the result independent of the session time zone.
    zoned = F.concat(text, F.lit("Z"))
    # A failed parse is slow, so only the one pattern that can fit is tried.
    slashes, iso = text.contains("/"), text.contains("T")
    read = {p: F.try_to_timestamp(zoned, F.lit(p + "X")) for p in (ISO_ZONED, ISO, DASHES, SLASHES)}
    return (
        F.when(slashes, read[SLASHES])
        .when(~iso, read[DASHES])
        .when(text.endswith("Z"), read[ISO_ZONED])
        .otherwise(read[ISO])
    )


def normalize_timestamp(value: ColumnLike) -> Column:
    """Epoch ms from epoch ms, epoch s (fractions cut) or one of the date patterns."""
    text = stripped(value)
    whole = text.try_cast("double").try_cast("bigint")
    scaled = F.when(whole > MILLISECONDS_ABOVE, whole).otherwise(
        F.try_multiply(whole, F.lit(1000).cast("bigint"))
    )
    return F.when(text.rlike(NUMBER), scaled).otherwise(F.unix_millis(_moment(text)))


def timestamp_format(value: ColumnLike) -> Column:
    """How a timestamp is written: epoch_ms, epoch_s, datetime or null."""
    text = stripped(value)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return (
        F.when(number > MILLISECONDS_ABOVE, "epoch_ms")
        .when(number.isNotNull(), "epoch_s")
        .when(_moment(text).isNotNull(), "datetime")
    )


def normalize_bool(value: ColumnLike) -> Column:
    word = F.lower(stripped(value))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def normalize_int(value: ColumnLike) -> Column:
    """Whole number or null; a fraction such as 100.5 is null too."""
    return as_column(value).cast("string").try_cast("bigint")


def quoted(value: ColumnLike) -> Column:
    """Text in quotes, the way reasons show a bad value."""
    text = as_column(value)
    for plain, shown in [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]:
        text = F.replace(text, F.lit(plain), F.lit(shown))
    single, double = text.contains("'"), text.contains('"')
    escaped = F.replace(text, F.lit("'"), F.lit("\\'"))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), text, F.lit('"')))
        .when(single, F.concat(F.lit("'"), escaped, F.lit("'")))
        .otherwise(F.concat(F.lit("'"), text, F.lit("'")))
    )
