"""Warm-up detection and the steady-state part of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.functions.columns import bucket_ms
from loadgauge.model import RUN_KEYS, run_keys
from loadgauge.plans.histogram import histogram, needs_samples, quantile, ranked
from loadgauge.plans.joining import join_facts, settle

# Bucket width, share of the peak rate that ends warm-up, latest end.
BUCKET_SECONDS = 5
PEAK_SHARE = 0.8
LATEST_SHARE = 0.5


def warmup(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, start_ms, warmup_end_ms, test_end_ms.

    Warm-up ends with the first 5 s bucket that reaches 80 % of the peak rate, at the
    latest halfway.  As buckets start on the clock, it may end before the first sample.
    The test ends at the last start plus the longest response.
    """
    by = run_keys(keys)
    needs_samples(samples)
    buckets = samples.groupBy(*by, bucket_ms("timestamp_ms", BUCKET_SECONDS).alias("at")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("timestamp_ms").alias("first"),
        F.max("timestamp_ms").alias("last"),
        F.max("elapsed").alias("longest"),
    )
    rate = F.col("rows") / float(BUCKET_SECONDS)
    peak = F.max(rate).over(Window.partitionBy(*by))
    runs = (
        buckets.withColumn("busy", rate >= peak * PEAK_SHARE)
        .groupBy(*by)
        .agg(
            F.min("first").alias("start_ms"),
            F.min(F.when(F.col("busy"), F.col("at"))).alias("busy_ms"),
            (F.max("last") + F.max("longest")).alias("test_end_ms"),
        )
    )
    half = (F.col("test_end_ms") - F.col("start_ms")) * F.lit(LATEST_SHARE)
    latest = (F.col("start_ms") + half).cast("bigint")
    return runs.select(
        *by, "start_ms", F.least("busy_ms", latest).alias("warmup_end_ms"), "test_end_ms"
    )


def steady(
    samples: DataFrame, bounds: DataFrame | None = None, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """The samples from warm-up end to test end.

    ``bounds`` is the result of ``warmup``; pass a stored one to several operators.
    Without it, one is computed and stored at once.
    """
    by = run_keys(keys)
    needs_samples(samples)
    bounds = settle(warmup(samples, by)) if bounds is None else bounds
    inside = F.col("timestamp_ms").between(F.col("warmup_end_ms"), F.col("test_end_ms"))
    return join_facts(samples, bounds, by).filter(inside).select(*samples.columns)


def steady_compare(
    samples: DataFrame, bounds: DataFrame | None = None, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """p90 and p99 of warm-up and steady phase per run; 0 for an empty phase."""
    by = run_keys(keys)
    needs_samples(samples)
    bounds = settle(warmup(samples, by)) if bounds is None else bounds
    ts = F.col("timestamp_ms")
    phase = F.when(ts < F.col("warmup_end_ms"), "Warmup").when(
        ts <= F.col("test_end_ms"), "Steady"
    )
    phased = join_facts(samples, bounds, by).select(*by, "elapsed", phase.alias("phase"))
    group = [*by, "phase"]
    found = (
        ranked(histogram(phased.filter("phase is not null"), group), group)
        .groupBy(*group)
        .agg(quantile(0.90).alias("p90"), quantile(0.99).alias("p99"))
    )
    phases = F.explode(F.array(F.lit("Warmup"), F.lit("Steady"))).alias("phase")
    both = bounds.select(*by, phases)
    return join_facts(both, found, group, "left").select(
        *group,
        F.coalesce("p90", F.lit(0.0)).alias("p90"),
        F.coalesce("p99", F.lit(0.0)).alias("p99"),
    )
