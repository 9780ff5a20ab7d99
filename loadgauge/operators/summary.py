"""Whole-run and per-label summaries."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgauge.functions.columns import apdex_band
from loadgauge.model import RUN_KEYS, run_keys
from loadgauge.plans.histogram import (
    histogram,
    mean_elapsed,
    needs_samples,
    quantile,
    ranked,
    row_count,
    std_elapsed,
    with_centre,
)

PERCENTILES = (0.5, 0.75, 0.90, 0.95, 0.99, 0.999)
CORRELATED = ("elapsed", "bytes", "latency", "connect", "grp_threads", "all_threads")


def percentile_name(p: float) -> str:
    return "p999" if abs(p - 0.999) < 1e-6 else f"p{round(p * 100)}"


def _names(ps: Sequence[float]) -> list[str]:
    names = [percentile_name(p) for p in ps]
    if len(set(names)) < len(names):
        raise ValueError(f"percentiles {list(ps)} share a column name: {names}")
    return names


def percentiles(
    samples: DataFrame,
    ps: Sequence[float] = PERCENTILES,
    by_label: bool = True,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """keys, [label], count, mean, std, min, max and one column per percentile."""
    by = [*run_keys(keys), "label"] if by_label else run_keys(keys)
    names = _names(ps)
    counts = with_centre(ranked(histogram(samples, by), by), by)
    return counts.groupBy(*by).agg(
        F.sum("n").alias("count"),
        mean_elapsed().alias("mean"),
        std_elapsed().alias("std"),
        F.min("elapsed").alias("min"),
        F.max("elapsed").alias("max"),
        *[quantile(p).alias(name) for p, name in zip(ps, names, strict=True)],
    )


def overall_percentiles(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, p50, p75, p90, p95, p99, p999 over all labels."""
    by = run_keys(keys)
    found = percentiles(samples, by_label=False, keys=by)
    return found.select(*by, *[percentile_name(p) for p in PERCENTILES])


def label_aggregate(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The summary stored with every ingest, one row per label."""
    by = [*run_keys(keys), "label"]
    counts = ranked(histogram(samples, by, errors=True), by)
    return counts.groupBy(*by).agg(
        F.sum("n").alias("count"),
        mean_elapsed().alias("mean_elapsed"),
        quantile(0.50).alias("p50"),
        quantile(0.90).alias("p90"),
        quantile(0.95).alias("p95"),
        quantile(0.99).alias("p99"),
        (F.sum("errors") / F.sum("n")).alias("error_rate"),
        F.min("elapsed").alias("min_elapsed"),
        F.max("elapsed").alias("max_elapsed"),
    )


def label_summary(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Counts, errors, response times, and mean bytes, latency and connect per label."""
    by = [*run_keys(keys), "label"]
    needs_samples(samples)
    extras = ["bytes", "latency", "connect"]
    # The means of the other columns ride along as sums per distinct response time.
    counts = samples.groupBy(*by, "elapsed").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~F.col("success")).alias("errors"),
        *[F.sum(F.col(c).cast("double")).alias(f"sum_{c}") for c in extras],
        *[F.count(c).alias(f"known_{c}") for c in extras],
    )
    return (
        ranked(counts, by)
        .groupBy(*by)
        .agg(
            F.sum("n").alias("count"),
            F.sum("errors").alias("error_count"),
            (F.sum("errors") / F.sum("n")).alias("error_rate"),
            mean_elapsed().alias("mean_elapsed"),
            quantile(0.50).alias("p50"),
            quantile(0.90).alias("p90"),
            quantile(0.95).alias("p95"),
            quantile(0.99).alias("p99"),
            F.min("elapsed").alias("min_elapsed"),
            F.max("elapsed").alias("max_elapsed"),
            *[
                F.try_divide(F.sum(f"sum_{c}"), F.sum(f"known_{c}")).alias(f"mean_{c}")
                for c in extras
            ],
        )
    )


def correlations(
    samples: DataFrame, columns: Sequence[str] = CORRELATED, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Pearson matrix as keys, col_a, col_b, correlation; 0 where it is undefined.

    One pass over the samples computes counts, means and co-moments, per set of columns
    that are null together: within such a set every pair covers the same rows.  The few
    sets (mostly one) are then combined, so each pair uses just the rows that have both.
    """
    by = run_keys(keys)
    needs_samples(samples)
    missing = " + ".join(f"if({c} IS NULL, {2**i}, 0)" for i, c in enumerate(columns))
    moments = [f"avg({c}) AS mean_{c}" for c in columns]
    moments += [f"var_pop({c}) AS cov_{c}_{c}" for c in columns]
    moments += [f"covar_pop({a}, {b}) AS cov_{a}_{b}" for a, b in combinations(columns, 2)]
    sets = samples.groupBy(*by, F.expr(missing).alias("missing")).agg(
        F.count(F.lit(1)).alias("n"), *map(F.expr, moments)
    )
    place = {c: i for i, c in enumerate(columns)}
    cells = []
    for a in columns:
        for b in columns:
            first, second = sorted((a, b), key=place.__getitem__)
            cells.append(
                f"struct('{a}' AS col_a, '{b}' AS col_b, mean_{a} AS x, mean_{b} AS y, "
                f"cov_{a}_{a} AS xx, cov_{b}_{b} AS yy, cov_{first}_{second} AS xy)"
            )
    pair = [*by, "col_a", "col_b"]
    over = "OVER (PARTITION BY " + ", ".join(f"`{c}`" for c in pair) + ")"
    centred = (
        sets.select(*by, "n", F.expr(f"inline(array({', '.join(cells)}))"))
        .withColumn("n", F.expr("CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN n END"))
        .selectExpr(
            "*",
            f"x - try_divide(sum(n * x) {over}, sum(n) {over}) AS dx",
            f"y - try_divide(sum(n * y) {over}, sum(n) {over}) AS dy",
        )
    )
    root = "sqrt(sum(n * (xx + dx * dx))) * sqrt(sum(n * (yy + dy * dy)))"
    r = f"coalesce(try_divide(sum(n * (xy + dx * dy)), {root}), 0D)"
    return centred.groupBy(*pair).agg(F.expr(r).alias("correlation"))


def apdex(
    samples: DataFrame, t: float = 0.5, f: float = 4.0, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Apdex per label: satisfied up to t seconds, tolerating up to f times t."""
    limit, far = t * 1000.0, f * t * 1000.0
    ms = F.col("elapsed")
    counted = samples.groupBy(*run_keys(keys), "label").agg(
        row_count(samples, ms <= limit).alias("satisfied"),
        row_count(samples, (ms > limit) & (ms <= far)).alias("tolerating"),
        row_count(samples, ms > far).alias("frustrated"),
        row_count(samples).alias("total"),
    )
    score = (F.col("satisfied") + F.col("tolerating") * F.lit(0.5)) / F.col("total")
    return counted.withColumn("apdex_score", score)


def apdex_bands(samples: DataFrame, t: float = 0.5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Apdex per label with its rating."""
    return apdex(samples, t, keys=keys).withColumn("band", apdex_band("apdex_score"))
