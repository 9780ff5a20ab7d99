"""SLO compliance, gauges and the headline figures of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadgauge.functions.columns import apdex_band
from loadgauge.model import RUN_KEYS, SloConfig, run_keys
from loadgauge.operators.segments import steady, warmup
from loadgauge.plans.histogram import histogram, needs_samples, quantile, ranked
from loadgauge.plans.joining import join_facts, settle

FAR = 4.0


def _apdex(t: float) -> Column:
    limit = t * 1000.0
    ms, n = F.col("elapsed"), F.col("n")
    points = F.when(ms <= limit, n * F.lit(1.0)).when(ms <= limit * FAR, n * F.lit(0.5))
    return F.coalesce(F.sum(points), F.lit(0.0)) / F.sum("n")


def _label_metrics(counts: DataFrame, by: list[str], t: float) -> DataFrame:
    return (
        ranked(counts, by)
        .groupBy(*by)
        .agg(
            quantile(0.90).alias("p90_ms"),
            quantile(0.99).alias("p99_ms"),
            (F.sum("errors") * 100.0 / F.sum("n")).alias("error_rate_pct"),
            _apdex(t).alias("apdex_score"),
        )
    )


def _judge(metrics: DataFrame, slo: SloConfig) -> DataFrame:
    return metrics.withColumns(
        {
            "p90_compliant": F.col("p90_ms") <= slo.p90_ms,
            "p99_compliant": F.col("p99_ms") <= slo.p99_ms,
            "error_rate_compliant": F.col("error_rate_pct") <= slo.error_rate_pct,
        }
    ).withColumn(
        "overall_compliant",
        F.expr("p90_compliant AND p99_compliant AND error_rate_compliant"),
    )


def steady_metrics(
    samples: DataFrame, bounds: DataFrame | None = None, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """keys, label, p90, p99, error_rate_pct over the steady state."""
    by = [*run_keys(keys), "label"]
    counts = histogram(steady(samples, bounds, keys), by, errors=True)
    found = _label_metrics(counts, by, SloConfig().apdex_t)
    return found.select(
        *by, F.col("p90_ms").alias("p90"), F.col("p99_ms").alias("p99"), "error_rate_pct"
    )


def slo_compliance(
    samples: DataFrame,
    slo: SloConfig | None = None,
    bounds: DataFrame | None = None,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Steady-state p90, p99, error rate and Apdex per label, each against its threshold."""
    slo = slo or SloConfig()
    by = [*run_keys(keys), "label"]
    counts = histogram(steady(samples, bounds, keys), by, errors=True)
    return _judge(_label_metrics(counts, by, slo.apdex_t), slo)


def overall_gauges(
    samples: DataFrame, slo: SloConfig | None = None, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Apdex, error rate and p99 of a run, with rating and threshold checks.

    The mean of the label scores weighted by their samples is the score of all samples.
    """
    slo = slo or SloConfig()
    by = run_keys(keys)
    return (
        ranked(histogram(samples, by, errors=True), by)
        .groupBy(*by)
        .agg(
            _apdex(slo.apdex_t).alias("apdex_score"),
            (F.sum("errors") / F.sum("n") * 100).alias("error_rate_pct"),
            quantile(0.99).alias("p99_ms"),
        )
        .withColumns(
            {
                "apdex_band": apdex_band("apdex_score"),
                "error_rate_ok": F.col("error_rate_pct") <= slo.error_rate_pct,
                "p99_ok": F.col("p99_ms") <= slo.p99_ms,
            }
        )
    )


def run_kpis(
    samples: DataFrame,
    slo: SloConfig | None = None,
    bounds: DataFrame | None = None,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """p50, p90, p99, mean label error rate, SLO verdict and samples of each run.

    The error rate is the plain mean over labels, whatever their size.  A run without a
    steady-state sample passes.  The samples are read once, into a stored histogram per
    label, and everything else comes from that.
    """
    slo = slo or SloConfig()
    by = run_keys(keys)
    label = [*by, "label"]
    needs_samples(samples)
    bounds = settle(warmup(samples, by)) if bounds is None else bounds
    inside = F.col("timestamp_ms").between(F.col("warmup_end_ms"), F.col("test_end_ms"))
    counts = settle(
        join_facts(samples, bounds, by)
        .groupBy(*label, "elapsed")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.col("success")).alias("errors"),
            F.count_if(inside).alias("steady_n"),
            F.count_if(inside & ~F.col("success")).alias("steady_errors"),
        )
    )
    overall = (
        ranked(counts.groupBy(*by, "elapsed").agg(F.sum("n").alias("n")), by)
        .groupBy(*by)
        .agg(
            quantile(0.50).alias("p50"),
            quantile(0.90).alias("p90"),
            quantile(0.99).alias("p99"),
            F.sum("n").alias("samples"),
        )
    )
    rates = (
        counts.groupBy(*label)
        .agg((F.sum("errors") / F.sum("n")).alias("rate"))
        .groupBy(*by)
        .agg((F.avg("rate") * 100).alias("mean_label_error_rate_pct"))
    )
    steady_counts = counts.filter("steady_n > 0").select(
        *label, "elapsed", F.col("steady_n").alias("n"), F.col("steady_errors").alias("errors")
    )
    verdicts = (
        _judge(_label_metrics(steady_counts, label, slo.apdex_t), slo)
        .groupBy(*by)
        .agg(F.bool_and("overall_compliant").alias("passes"))
    )
    joined = join_facts(join_facts(overall, rates, by, "left"), verdicts, by, "left")
    passes = F.coalesce("passes", F.lit(True))
    return joined.select(
        *by,
        "p50",
        "p90",
        "p99",
        "mean_label_error_rate_pct",
        F.when(passes, "PASS").otherwise("FAIL").alias("slo_status"),
        "samples",
    )
