"""Metrics per tumbling time bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgauge.functions.columns import is_error, time_bucket, transfer_time
from loadgauge.model import RUN_KEYS, SloConfig, run_keys
from loadgauge.operators.sampling import top_labels
from loadgauge.plans.histogram import (
    histogram,
    mean_elapsed,
    needs_samples,
    needs_width,
    quantile,
    ranked,
    row_count,
)
from loadgauge.plans.joining import join_facts, settle

TOTAL_LABEL = "ALL"


def bucketed(samples: DataFrame, seconds: int) -> DataFrame:
    needs_width(samples, seconds)
    return samples.withColumn("bucket", time_bucket("timestamp_ms", seconds))


def ranked_buckets(samples: DataFrame, seconds: int, by: list[str], errors: bool = False):
    return ranked(histogram(bucketed(samples, seconds), by, errors), by).groupBy(*by)


def throughput(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, label, is_total, rps: per label, and over all labels as ALL.

    is_total tells the total from a transaction that is really called ALL.
    """
    by = [*run_keys(keys), "bucket"]
    counts = bucketed(samples, b).groupBy(*by, "label").agg(row_count(samples).alias("rows"))
    sets = counts.groupingSets([[*by], [*by, "label"]], *by, "label").agg(
        (F.grouping("label") == 1).alias("is_total"), (F.sum("rows") / float(b)).alias("rps")
    )
    label = F.when(F.col("is_total"), TOTAL_LABEL).otherwise(F.col("label"))
    return sets.select(*by, label.alias("label"), "is_total", "rps")


def total_throughput(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, rps over all labels."""
    by = [*run_keys(keys), "bucket"]
    return bucketed(samples, b).groupBy(*by).agg((row_count(samples) / float(b)).alias("rps"))


def errors(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, error_count, total_count, error_rate, response_code (most failures).

    Codes are counted first, so a hot bucket reaches its reducer as one row per code.
    """
    by = [*run_keys(keys), "bucket"]
    failed = F.when(is_error(), F.col("response_code"))
    counts = (
        bucketed(samples, b)
        .groupBy(*by, is_error().alias("failed"), failed.alias("code"))
        .agg(row_count(samples).alias("rows"))
    )
    error_count = F.coalesce(F.sum(F.when(F.col("failed"), F.col("rows"))), F.lit(0))
    order = F.when(F.col("code").isNotNull(), F.struct(-F.col("rows"), F.col("code")))
    return counts.groupBy(*by).agg(
        error_count.alias("error_count"),
        F.sum("rows").alias("total_count"),
        (error_count / F.sum("rows")).alias("error_rate"),
        F.min_by("code", order).alias("response_code"),
    )


def rt_series(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, label, p50, p90, p95, p99, mean, min, max."""
    by = [*run_keys(keys), "bucket", "label"]
    return ranked_buckets(samples, b, by).agg(
        quantile(0.50).alias("p50"),
        quantile(0.90).alias("p90"),
        quantile(0.95).alias("p95"),
        quantile(0.99).alias("p99"),
        mean_elapsed().alias("mean"),
        F.min("elapsed").alias("min"),
        F.max("elapsed").alias("max"),
    )


def threads(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, highest grp_threads and all_threads."""
    return (
        bucketed(samples, b)
        .groupBy(*run_keys(keys), "bucket")
        .agg(
            F.max("grp_threads").alias("grp_threads"),
            F.max("all_threads").alias("all_threads"),
        )
    )


def transferred(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, total_bytes, total_sent_bytes, bytes_per_sec."""
    return (
        bucketed(samples, b)
        .groupBy(*run_keys(keys), "bucket")
        .agg(
            F.sum("bytes").alias("total_bytes"),
            F.sum("sent_bytes").alias("total_sent_bytes"),
            (F.sum("bytes") / float(b)).alias("bytes_per_sec"),
        )
    )


def bucket_quantiles(
    samples: DataFrame, b: int, ps: dict[str, float], keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """keys, bucket and the named quantiles of the response time."""
    by = [*run_keys(keys), "bucket"]
    named = [quantile(p).alias(name) for name, p in ps.items()]
    return ranked_buckets(samples, b, by).agg(*named)


def percentile_fan(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    levels = (50, 60, 70, 80, 90, 95, 99)
    return bucket_quantiles(samples, b, {f"p{q}": q / 100 for q in levels}, keys)


def errors_by_code(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Failures per (bucket, response_code), and per bucket with total and error_rate_pct.

    Rows with is_total hold the bucket, the others one failing code each.
    """
    by = [*run_keys(keys), "bucket"]
    code = F.when(is_error(), F.col("response_code"))
    counts = (
        bucketed(samples, b)
        .groupBy(*by, is_error().alias("failed"), code.alias("response_code"))
        .agg(row_count(samples).alias("rows"))
    )
    split = [*by, "failed", "response_code"]
    sets = counts.groupingSets([by, split], *split).agg(
        (F.grouping("failed") == 1).alias("is_total"),
        F.coalesce(F.sum(F.when(F.col("failed"), F.col("rows"))), F.lit(0)).alias("failures"),
        F.sum("rows").alias("rows"),
    )
    total = F.when(F.col("is_total"), F.col("rows"))
    return sets.filter("is_total or failed").select(
        *by,
        "is_total",
        "response_code",
        F.when(F.col("is_total"), F.col("failures")).otherwise(F.col("rows")).alias("error_count"),
        total.alias("total_count"),
        (F.col("failures") / total * 100).alias("error_rate_pct"),
    )


def threads_vs_rt(samples: DataFrame, b: int = 5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, highest all_threads, p90."""
    by = [*run_keys(keys), "bucket"]
    counts = (
        bucketed(samples, b)
        .groupBy(*by, "elapsed")
        .agg(row_count(samples).alias("n"), F.max("all_threads").alias("all_threads"))
    )
    return (
        ranked(counts, by)
        .groupBy(*by)
        .agg(F.max("all_threads").alias("all_threads"), quantile(0.90).alias("p90"))
    )


def sli_burn(
    samples: DataFrame,
    slo: SloConfig | None = None,
    b: int = 10,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Error rate and p99 per bucket beside their thresholds."""
    slo = slo or SloConfig()
    by = [*run_keys(keys), "bucket"]
    found = ranked_buckets(samples, b, by, errors=True).agg(
        (F.sum("errors") / F.sum("n") * 100).alias("error_rate_pct"), quantile(0.99).alias("p99")
    )
    return found.withColumns(
        {
            "error_threshold_pct": F.lit(float(slo.error_rate_pct)),
            "p99_threshold_ms": F.lit(float(slo.p99_ms)),
            "error_breach": F.col("error_rate_pct") > slo.error_rate_pct,
            "p99_breach": F.col("p99") > slo.p99_ms,
        }
    )


def _means(samples: DataFrame, b: int, keys: Sequence[str], names: dict[str, str]) -> DataFrame:
    needs_samples(samples)
    means = [F.avg(column).alias(name) for name, column in names.items()]
    return bucketed(samples, b).groupBy(*run_keys(keys), "bucket").agg(*means)


def connect_breakdown(samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Mean connect, latency and idle_time per bucket."""
    return _means(samples, b, keys, {c: c for c in ("connect", "latency", "idle_time")})


def latency_components(
    samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Mean connect, first-byte and transfer time per bucket."""
    timed = samples.withColumn("transfer", transfer_time())
    return _means(timed, b, keys, {f"{c}_mean": c for c in ("connect", "latency", "transfer")})


def throughput_efficiency(
    samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Bytes in and out per millisecond of response time; 0 where no time passed."""
    needs_samples(samples)
    zero = F.lit(0).cast("bigint")
    moved = F.coalesce(F.sum("bytes"), zero) + F.coalesce(F.sum("sent_bytes"), zero)
    rate = F.coalesce(F.try_divide(moved, F.sum("elapsed")), F.lit(0.0))
    return (
        bucketed(samples, b)
        .groupBy(*run_keys(keys), "bucket")
        .agg(rate.alias("bytes_per_ms"))
    )


def label_errors(samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Error rate per label and bucket."""
    failed = row_count(samples, ~F.col("success"))
    return (
        bucketed(samples, b)
        .groupBy(*run_keys(keys), "bucket", "label")
        .agg(
            failed.alias("error_count"),
            row_count(samples).alias("total_count"),
            (failed / row_count(samples)).alias("error_rate"),
        )
    )


def top_label_series(
    samples: DataFrame, labels: int | None = 12, b: int = 10, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """p90 per bucket for the labels with most samples (ties by label), or for all with None.

    The labels are chosen first, by one narrow pass; the quantiles then see their rows only.
    """
    run = run_keys(keys)
    by = [*run, "bucket", "label"]
    if labels is not None:
        chosen = settle(top_labels(samples, labels, run).select(*run, "label"))
        samples = join_facts(samples, chosen, [*run, "label"], "left_semi")
    return ranked_buckets(samples, b, by).agg(quantile(0.90).alias("p90"))
