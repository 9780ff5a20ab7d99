"""Exact order statistics from response-time histograms.

elapsed is a whole number of milliseconds, so a group of any size has few distinct
values.  Level one counts rows per (group, elapsed): it combines on the map side and
spreads a hot group over all reducers, as elapsed is part of the shuffle key.  Level two
ranks the distinct values of a group with one spillable window; the aggregation that
picks the quantiles reuses its partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadgauge.functions.columns import bucket_ms

# A table with this column is a rollup: each row stands for that many samples.  The column's
# metadata hold the width of the buckets; Parquet keeps them.
WEIGHT = "__rollup_rows"
WIDTH = "seconds"


def needs_samples(rows: DataFrame) -> None:
    """Refuse a rollup where single samples are needed."""
    if WEIGHT in rows.columns:
        raise ValueError(f"this operator needs samples, not a rollup (column {WEIGHT!r})")


def needs_width(rows: DataFrame, seconds: int) -> None:
    """Refuse a rollup whose buckets do not make up buckets of ``seconds``."""
    if WEIGHT in rows.columns:
        width = rows.schema[WEIGHT].metadata.get(WIDTH)
        if not width or seconds % width:
            raise ValueError(f"buckets of {seconds} s cannot be made of a rollup of {width} s")


def row_count(rows: DataFrame, condition: Column | None = None) -> Column:
    """Aggregate: number of samples (for which the condition holds), never null."""
    if WEIGHT not in rows.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    if condition is None:
        return F.sum(WEIGHT)
    return F.coalesce(F.sum(F.when(condition, F.col(WEIGHT))), F.lit(0).cast("bigint"))


def histogram(rows: DataFrame, by: Sequence[str], errors: bool = False) -> DataFrame:
    """Level one: by..., elapsed, n (and errors, the failed ones among n)."""
    counts = [row_count(rows).alias("n")]
    if errors:
        counts.append(row_count(rows, ~F.col("success")).alias("errors"))
    return rows.groupBy(*by, "elapsed").agg(*counts)


def _listed(by: Sequence[str]) -> str:
    return ", ".join(f"`{name}`" for name in by)


def ranked(counts: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Level two: adds upto (rows at or below elapsed) and total per group.

    Rows without elapsed get upto 0 and do not count.
    """
    known = f"sum(CASE WHEN elapsed IS NULL THEN 0 ELSE {n} END)"
    running = (
        f"OVER (PARTITION BY {_listed(by)} ORDER BY elapsed "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return counts.selectExpr(
        "*", f"{known} {running} AS upto", f"{known} {whole_group(by)} AS total"
    )


def whole_group(by: Sequence[str]) -> str:
    """SQL window over all values of a group, sharing the sort of ``ranked``."""
    return (
        f"OVER (PARTITION BY {_listed(by)} ORDER BY elapsed "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    )


def _value_at(index: str, over: str) -> str:
    # Value at a 0-based index of the sorted group.
    return f"min(CASE WHEN upto > {index} THEN elapsed END) {over}"


def quantile(p: float, over: str = "") -> Column:
    """Linearly interpolated quantile of a ranked histogram.

    An aggregate, or with ``over`` from whole_group a window function.
    """
    position = f"((total - 1) * {float(p)!r}D)"
    low, high = _value_at(f"floor({position})", over), _value_at(f"ceil({position})", over)
    part = f"max({position} - floor({position})) {over}"
    return F.expr(f"{low} + ({high} - {low}) * {part}")


def nearest_quantile(p: float) -> str:
    """SQL aggregate: sample value nearest to the quantile, halves away from zero."""
    return _value_at(f"round((total - 1) * {float(p)!r}D)", "")


def mean_elapsed() -> Column:
    return F.expr("sum(CAST(elapsed AS DOUBLE) * n) / nullif(max(total), 0)")


def with_centre(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds the group mean to a ranked histogram, for std_elapsed."""
    weighted = f"sum(CAST(elapsed AS DOUBLE) * n) {whole_group(by)}"
    return counts.selectExpr("*", f"try_divide({weighted}, total) AS centre")


def std_elapsed() -> Column:
    """Sample standard deviation around the known mean; null for a single row."""
    squares = "sum((elapsed - centre) * (elapsed - centre) * n)"
    return F.expr(f"CASE WHEN max(total) > 1 THEN sqrt({squares} / nullif(max(total) - 1, 0)) END")


def rollup(samples: DataFrame, seconds: int = 5, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Samples per (run, bucket, label, outcome, code, elapsed), as a smaller samples table.

    Holds the row count, the highest thread counts and the summed bytes.  Operators over
    those columns, and buckets that are multiples of ``seconds``, give the same results on
    it; the others refuse it.
    """
    needs_width(samples, seconds)
    start = bucket_ms("timestamp_ms", seconds).alias("timestamp_ms")
    return samples.groupBy(
        *keys, start, "label", "success", "response_code", "elapsed"
    ).agg(
        row_count(samples).alias(WEIGHT, metadata={WIDTH: seconds}),
        F.max("grp_threads").alias("grp_threads"),
        F.max("all_threads").alias("all_threads"),
        F.sum("bytes").alias("bytes"),
        F.sum("sent_bytes").alias("sent_bytes"),
    )
