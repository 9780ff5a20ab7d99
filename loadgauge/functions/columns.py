"""Column expressions over the samples table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Response-time bands as (exclusive upper edge in ms, name).
RT_BANDS = [
    (100, "0-100"),
    (250, "100-250"),
    (500, "250-500"),
    (1000, "500-1k"),
    (2000, "1k-2k"),
    (5000, "2k-5k"),
    (None, "5k+"),
]

# Score and variability limits, printed URL length.
APDEX_GOOD, APDEX_FAIR = 0.85, 0.70
CV_HIGH, CV_VERY_HIGH = 1.0, 2.0
URL_LENGTH = 60


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bucket_ms(ts_ms: ColumnLike, seconds: int) -> Column:
    """Start of the tumbling bucket in epoch milliseconds (integer arithmetic)."""
    ts = as_column(ts_ms)
    return ts - ts % F.lit(seconds * 1000)


def time_bucket(ts_ms: ColumnLike, seconds: int) -> Column:
    """Start of the tumbling bucket as a timestamp."""
    return F.timestamp_millis(bucket_ms(ts_ms, seconds))


def rt_band(elapsed: ColumnLike) -> Column:
    """Name of the response-time band, edges closed on the left."""
    ms = as_column(elapsed)
    band = F.lit(RT_BANDS[-1][1])
    for edge, name in reversed(RT_BANDS[:-1]):
        band = F.when(ms < edge, name).otherwise(band)
    return band


def is_error(success: ColumnLike = "success") -> Column:
    """True only for a sample known to have failed; an unknown outcome is no error."""
    return F.coalesce(~as_column(success), F.lit(False))


def status_group(success: ColumnLike = "success", code: ColumnLike = "response_code") -> Column:
    return (
        F.when(as_column(success), "Success")
        .when(as_column(code).startswith("4"), "Client Error")
        .otherwise("Server Error")
    )


def transfer_time() -> Column:
    """Time left after connect, first byte and idle; 0 if negative or unknown."""
    left = F.col("elapsed") - F.col("latency") - F.col("connect") - F.col("idle_time")
    return F.greatest(left, F.lit(0).cast("bigint"))


def apdex_band(score: ColumnLike) -> Column:
    value = as_column(score)
    return F.when(value >= APDEX_GOOD, "good").when(value >= APDEX_FAIR, "fair").otherwise("poor")


def variability_band(cv: ColumnLike) -> Column:
    value = as_column(cv)
    return (
        F.when(value > CV_VERY_HIGH, "very high").when(value > CV_HIGH, "high").otherwise("normal")
    )


def time_text(ts_ms: ColumnLike) -> Column:
    return F.date_format(F.timestamp_millis(as_column(ts_ms)), "yyyy-MM-dd HH:mm:ss")


def short_url(url: ColumnLike) -> Column:
    """URL cut to its first characters for tables; a missing one prints as None."""
    text = F.coalesce(as_column(url), F.lit("None"))
    cut = F.concat(F.substring(text, 1, URL_LENGTH), F.lit("…"))
    return F.when(F.length(text) > URL_LENGTH, cut).otherwise(text)


def with_label(label: str) -> Column:
    """Filter for one transaction; reaches the Parquet scan."""
    return F.col("label") == label
