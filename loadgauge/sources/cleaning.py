"""Typed samples out of raw strings; bad rows are set aside with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.functions.parsing import (
    normalize_bool,
    normalize_int,
    normalize_timestamp,
    quoted,
    stripped,
)
from loadgauge.model import QUARANTINE_SCHEMA, SAMPLES_SCHEMA

CANONICAL = SAMPLES_SCHEMA.fieldNames()
REASON_FIELDS = QUARANTINE_SCHEMA.fieldNames()
UNREAD = "unread_xml"


def _typed(name: str, kind: T.DataType, present: bool) -> Column:
    if not present:
        return F.lit(None).cast(kind)
    if name == "timestamp_ms":
        return normalize_timestamp(name)
    if isinstance(kind, T.BooleanType):
        return normalize_bool(name)
    return normalize_int(name) if isinstance(kind, T.LongType) else F.col(name).cast("string")


# The texts of the reasons below.
def _elapsed_reason(strict: bool) -> Column:
    raw, ms = F.col("elapsed").cast("string"), normalize_int("elapsed")
    if not strict:
        return F.when(ms.isNull(), "elapsed is null").when(
            ms < 0, F.concat(F.lit("elapsed is negative: "), ms.cast("string"))
        )
    number = stripped(raw).try_cast("double")
    return (
        F.when(raw.isNull(), "missing required field: elapsed")
        .when(number.isNull(), F.concat(F.lit("elapsed is not numeric: "), quoted(raw)))
        .when(number < 0, F.concat(F.lit("elapsed is negative: "), raw))
    )


def _timestamp_reason(strict: bool) -> Column:
    raw = F.col("timestamp_ms").cast("string")
    reason = F.when(raw.isNull(), "missing required field: timestamp_ms")
    if strict:
        return reason
    unread = F.concat(F.lit("unparseable timestamp: "), quoted(raw))
    return reason.when(normalize_timestamp("timestamp_ms").isNull(), unread)


def assess(raw: DataFrame, reasons: str = "clean") -> DataFrame:
    """One pass over raw rows: other columns, 16 typed columns, row_index, reason, raw_json.

    ``reason`` is empty for a good row.  A column the source lacks becomes null and gives
    no reason, except under ``reasons="validate"``, which reports required columns as
    missing and words bad elapsed values more precisely.  row_index tells rows apart, but
    has gaps.  raw_json holds the text as it was read.
    """
    return raw.select(*assessment(raw.columns, reasons, raw.isStreaming))


def assessment(columns: Sequence[str], reasons: str = "clean", streaming: bool = False) -> list[Column]:
    """What ``assess`` selects from raw rows of these columns; takes half a second to build, and serves any such rows."""
    if reasons not in ("clean", "validate"):
        raise ValueError(f"unknown reasons {reasons!r}")
    strict = reasons == "validate"
    present = [name for name in CANONICAL if name in columns]
    parts = []
    for name, words in (("elapsed", _elapsed_reason), ("timestamp_ms", _timestamp_reason)):
        if name in present:
            parts.append(words(strict))
        elif strict:
            parts.append(F.lit(f"missing required field: {name}"))
    reason = F.concat_ws("; ", *parts) if parts else F.lit("")
    if UNREAD in columns:
        reason = F.when(F.col(UNREAD).isNotNull(), "not a whole XML element").otherwise(
            reason
        )
        present = [*present, UNREAD]
    text = F.to_json(
        F.struct(*[F.col(c).cast("string").alias(c) for c in present]),
        {"ignoreNullFields": "false"},
    )
    others = [F.col(c) for c in columns if c not in [*CANONICAL, UNREAD]]
    bad = reason != ""
    # Streams have no row numbers.
    index = F.lit(None) if streaming else F.monotonically_increasing_id()
    return [
        *others,
        *[_typed(f.name, f.dataType, f.name in present).alias(f.name) for f in SAMPLES_SCHEMA],
        index.cast("bigint").alias("row_index"),
        reason.alias("reason"),
        F.when(bad, text).alias("raw_json"),
    ]


def good_rows(assessed: DataFrame) -> DataFrame:
    return assessed.filter("reason = ''").drop(*REASON_FIELDS)


def bad_rows(assessed: DataFrame) -> DataFrame:
    others = [c for c in assessed.columns if c not in [*CANONICAL, *REASON_FIELDS]]
    return assessed.filter("reason <> ''").select(*others, *REASON_FIELDS)


def clean(raw: DataFrame, reasons: str = "clean") -> tuple[DataFrame, DataFrame]:
    """(samples, quarantine), both lazy over the same plan."""
    assessed = assess(raw, reasons)
    return good_rows(assessed), bad_rows(assessed)
