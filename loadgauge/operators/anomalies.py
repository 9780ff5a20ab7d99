"""Spikes, saturation knee, outliers and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.model import RUN_KEYS, run_keys
from loadgauge.operators.series import ranked_buckets, bucket_quantiles, bucketed
from loadgauge.plans.histogram import (
    histogram,
    nearest_quantile,
    quantile,
    ranked,
    row_count,
)
from loadgauge.plans.joining import join_facts, settle

# Floors and factors of the rules.
SPIKE_FACTOR, RATE_FLOOR = 2.0, 0.001
KNEE_BUCKET, KNEE_FACTOR, SLOPE_FLOOR = 10, 2.0, 0.1
FENCE = 1.5


def _with_z(buckets: DataFrame, by: list[str]) -> DataFrame:
    run = Window.partitionBy(*by)
    std = F.stddev_samp("p95").over(run)
    z = F.when(std > 0, (F.col("p95") - F.avg("p95").over(run)) / std).otherwise(0.0)
    return buckets.withColumn("z_score", z)


def rt_spikes(
    samples: DataFrame, z: float = 3.0, b: int = 10, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """keys, bucket, p95, z_score, is_anomaly over the buckets of a run.

    With n buckets |z| is at most (n - 1) / sqrt(n): fewer than 11 never pass z = 3.
    """
    buckets = bucket_quantiles(samples, b, {"p95": 0.95}, keys)
    return _with_z(buckets, run_keys(keys)).withColumn("is_anomaly", F.abs("z_score") > z)


def rt_over_time(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, p50, p90, p95, p99, is_anomaly."""
    levels = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}
    marked = _with_z(bucket_quantiles(samples, b, levels, keys), run_keys(keys))
    return marked.withColumn("is_anomaly", F.abs("z_score") > 3.0).drop("z_score")


def error_spikes(
    samples: DataFrame, b: int = 10, min_rate: float = 0.05, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Buckets whose error rate passes min_rate and twice the mean bucket rate."""
    by = run_keys(keys)
    failed = row_count(samples, ~F.col("success"))
    buckets = (
        bucketed(samples, b)
        .groupBy(*by, "bucket")
        .agg(failed.alias("error_count"), row_count(samples).alias("total_count"))
        .withColumn("error_rate", F.col("error_count") / F.col("total_count"))
    )
    mean = F.avg("error_rate").over(Window.partitionBy(*by))
    return (
        buckets.withColumn("limit", F.greatest(mean, F.lit(RATE_FLOOR)) * SPIKE_FACTOR)
        .filter((F.col("error_rate") > min_rate) & (F.col("error_rate") > F.col("limit")))
        .drop("limit")
    )


def rate_vs_p90(samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, rps, p90."""
    by = [*run_keys(keys), "bucket"]
    return ranked_buckets(samples, b, by).agg(
        (F.sum("n") / float(b)).alias("rps"), quantile(0.90).alias("p90")
    )


def knee(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, knee_rps, knee_p90_ms; no row for a run without a knee."""
    return knee_of(rate_vs_p90(samples, KNEE_BUCKET, keys), keys)


def knee_of(buckets: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """First bucket in order of load that is clearly slower than the quiet quarter.

    Both the step in p90 and p90 itself must pass twice the mean of the first quarter.
    Equal rates are ordered by time.
    """
    by = run_keys(keys)
    run, load = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("rps", "bucket")
    quarter = F.greatest(F.lit(1), F.floor(F.col("size") / 4))
    stepped = buckets.withColumns(
        {
            "place": F.row_number().over(load),
            "step": F.col("p90") - F.lag("p90").over(load),
            "size": F.count(F.lit(1)).over(run),
        }
    ).withColumn("quarter", quarter)
    # n steps follow the first n + 1 buckets, but n response times the first n.
    slope = F.sum(F.when(F.col("place") <= F.col("quarter") + 1, F.col("step"))).over(run)
    quiet = F.sum(F.when(F.col("place") <= F.col("quarter"), F.col("p90"))).over(run)
    steep = F.greatest(F.col("slope"), F.lit(SLOPE_FLOOR)) * KNEE_FACTOR
    return (
        stepped.withColumns({"slope": slope / F.col("quarter"), "quiet": quiet / F.col("quarter")})
        .filter((F.col("size") >= 3) & (F.col("step") > steep))
        .filter(F.col("p90") > F.col("quiet") * KNEE_FACTOR)
        .groupBy(*by)
        .agg(
            F.min_by("rps", "place").alias("knee_rps"),
            F.min_by("p90", "place").alias("knee_p90_ms"),
        )
    )


def _position(by: list[str]):
    return (F.row_number().over(Window.partitionBy(*by).orderBy("bucket")) - 1).alias(
        "bucket_index"
    )


def rt_vs_throughput(samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, bucket_index (in time order), rps, p90."""
    by = run_keys(keys)
    return rate_vs_p90(samples, b, by).select(*by, "bucket", _position(by), "rps", "p90")


def rt_vs_concurrency(samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, bucket_index, threads (highest), p90."""
    by = run_keys(keys)
    counts = (
        bucketed(samples, b)
        .groupBy(*by, "bucket", "elapsed")
        .agg(row_count(samples).alias("n"), F.max("all_threads").alias("threads"))
    )
    found = (
        ranked(counts, [*by, "bucket"])
        .groupBy(*by, "bucket")
        .agg(F.max("threads").alias("threads"), quantile(0.90).alias("p90"))
    )
    return found.select(*by, "bucket", _position(by), "threads", "p90")


def linear_trend(
    samples: DataFrame, b: int = 10, points: int = 100, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Fitted p90 over rps as keys, point, rps, p90; no rows without a spread in rps."""
    by = run_keys(keys)
    fit = (
        rate_vs_p90(samples, b, by)
        .groupBy(*by)
        .agg(
            F.regr_slope("p90", "rps").alias("slope"),
            F.regr_intercept("p90", "rps").alias("intercept"),
            F.min("rps").alias("low"),
            F.max("rps").alias("high"),
        )
        .filter("high > low")
    )
    line = fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    rps = F.col("low") + (F.col("high") - F.col("low")) * F.col("point") / float(points - 1)
    return line.withColumn("rps", rps).select(
        *by, "point", "rps", (F.col("slope") * F.col("rps") + F.col("intercept")).alias("p90")
    )


def iqr_fences(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, label, low_fence, high_fence from the nearest quartiles."""
    by = [*run_keys(keys), "label"]
    q1, q3 = nearest_quantile(0.25), nearest_quantile(0.75)
    return (
        ranked(histogram(samples, by), by)
        .groupBy(*by)
        .agg(
            F.expr(f"{q1} - ({q3} - {q1}) * {FENCE}D AS low_fence"),
            F.expr(f"{q3} + ({q3} - {q1}) * {FENCE}D AS high_fence"),
        )
    )


def outside_fences():
    ms = F.col("elapsed")
    outside = (ms < F.col("low_fence")) | (ms > F.col("high_fence"))
    return F.coalesce(outside, F.lit(False)).alias("is_outlier")


def iqr_outliers(
    samples: DataFrame, fences: DataFrame | None = None, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """All samples with is_outlier, judged against the fences of their label."""
    by = [*run_keys(keys), "label"]
    fences = settle(iqr_fences(samples, keys)) if fences is None else fences
    judged = join_facts(samples, fences, by, "left")
    return judged.select(*samples.columns, outside_fences())


def label_mix(samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, label, rows, share_pct of the bucket, for labels seen in it."""
    by = [*run_keys(keys), "bucket"]
    counts = bucketed(samples, b).groupBy(*by, "label").agg(row_count(samples).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(*by))
    return counts.withColumn("share_pct", F.col("rows") / total * 100)
