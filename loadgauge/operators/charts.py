"""Tidy datasets behind the performance charts, and their registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.functions.columns import (
    RT_BANDS,
    is_error,
    rt_band,
    short_url,
    status_group,
    time_text,
    variability_band,
    with_label,
)
from loadgauge.model import RUN_KEYS, SloConfig, run_keys
from loadgauge.operators import anomalies, sampling, segments, series, slo, summary
from loadgauge.plans.histogram import (
    histogram,
    mean_elapsed,
    needs_samples,
    quantile,
    ranked,
    rollup,
    row_count,
    whole_group,
)
from loadgauge.plans.joining import join_facts, settle

# Edges and names of the error-rate bands, most thread bins, CDF points.
ERROR_EDGES = [-0.01, 0.01, 1.0, 5.0, 25.0, 100.0]
ERROR_BANDS = ["≈0%", "0–1%", "1–5%", "5–25%", ">25%"]
THREAD_BINS_MIN, THREAD_BINS_MAX = 3, 8
CDF_POINTS = 2000


def rt_scatter(
    samples: DataFrame,
    limit: int = sampling.SCATTER_LIMIT,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """A label-stratified sample: keys, ts, label, elapsed, total_rows."""
    by = run_keys(keys)
    picked = sampling.stratified_sample(samples, limit, keys=by)
    ts = F.timestamp_millis("timestamp_ms").alias("ts")
    return picked.select(*by, ts, "label", "elapsed", "total_rows")


def outlier_scatter(
    samples: DataFrame,
    limit: int = sampling.SCATTER_LIMIT,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """rt_scatter with is_outlier; the fences come from all samples."""
    by = run_keys(keys)
    picked = rt_scatter(samples, limit, by)
    judged = join_facts(picked, anomalies.iqr_fences(samples, by), [*by, "label"], "left")
    return judged.select(*picked.columns, anomalies.outside_fences())


def rt_by_status(
    samples: DataFrame, n: int = sampling.STATUS_LIMIT, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """A uniform sample: keys, ts, elapsed, status, total_rows."""
    by = run_keys(keys)
    grouped = samples.withColumn("status", status_group())
    picked = sampling.uniform_sample(grouped, n, ["timestamp_ms", "elapsed", "status"], by)
    ts = F.timestamp_millis("timestamp_ms").alias("ts")
    return picked.select(*by, ts, "elapsed", "status", "total_rows")


def transaction_mix(
    samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS, labels: int | None = None
) -> DataFrame:
    """Share of every label in every bucket of its run, 0 where it is absent.

    The filled grid is the result itself: buckets times labels of a run, or times the
    ``labels`` with most samples.  ``anomalies.label_mix`` has the shares without the zeros,
    for runs with many labels.  The shares are stored first, so the samples are read once
    for all three parts of the grid.
    """
    by = run_keys(keys)
    mix = settle(anomalies.label_mix(samples, b, by))
    shares = mix.drop("rows")
    buckets = shares.select(*by, "bucket").distinct()
    shown = mix.groupBy(*by, "label").agg(F.sum("rows").alias("rows"))
    if labels is not None:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rows"), "label"))
        shown = shown.withColumn("place", place).filter(F.col("place") <= labels)
    grid = join_facts(buckets, shown.select(*by, "label"), by)
    filled = join_facts(grid, shares, [*by, "bucket", "label"], "left")
    return filled.withColumn("share_pct", F.coalesce("share_pct", F.lit(0.0)))


def rt_histogram(
    samples: DataFrame,
    bins: int = 50,
    label: str | None = None,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Equal-width bins from the fastest to the slowest sample of a run.

    keys, bin, low, high, rows, p50, p90, p99.  The slowest sample falls in the last bin.
    """
    by = run_keys(keys)
    chosen = samples if label is None else samples.filter(with_label(label))
    counts = histogram(chosen.filter("elapsed is not null"), by)
    whole = whole_group(by)
    placed = (
        ranked(counts, by)
        .selectExpr("*", f"min(elapsed) {whole} AS low", f"max(elapsed) {whole} AS high")
        .selectExpr(
            "*",
            f"least({bins - 1}, floor(coalesce(try_divide("
            f"(elapsed - low) * {float(bins)!r}D, high - low), 0D))) AS bin",
        )
    )
    in_bin = ", ".join(f"sum(CASE WHEN bin = {i} THEN n ELSE 0 END)" for i in range(bins))
    runs = placed.groupBy(*by).agg(
        F.expr("min(low) AS first"),
        F.expr(f"(max(high) - min(low)) / {float(bins)!r}D AS width"),
        F.expr(f"array({in_bin}) AS filled"),
        *[quantile(q / 100).alias(f"p{q}") for q in (50, 90, 99)],
    )
    unfolded = runs.selectExpr("*", "posexplode(filled) AS (bin, rows)")
    edges = ["first + width * bin AS low", "first + width * bin + width AS high"]
    return unfolded.select(*by, "bin", *map(F.expr, edges), "rows", "p50", "p90", "p99")


def rt_cdf(
    samples: DataFrame, points: int = CDF_POINTS, keys: Sequence[str] = RUN_KEYS
) -> DataFrame:
    """Cumulative distribution at every k-th sorted sample, k = rows // points.

    keys, point, elapsed, cdf_pct, p90, p95, p99.  The points come out of the ranked
    histogram; the samples themselves are never sorted.
    """
    by = run_keys(keys)
    counts = ranked(histogram(samples.filter("elapsed is not null"), by), by)
    whole = whole_group(by)
    levels = {f"p{q}": quantile(q / 100, whole) for q in (90, 95, 99)}
    return (
        counts.withColumns(levels)
        .selectExpr("*", f"greatest(1, total div {points}) AS step")
        .selectExpr(
            "*", "ceil((upto - n) / step) AS first", "(upto - 1) div step AS last"
        )
        .filter("first <= last")
        .selectExpr("*", "explode(sequence(first, last)) AS point")
        .selectExpr("*", "(point + 1) / ceil(total / step) * 100 AS cdf_pct")
        .select(*by, "point", "elapsed", "cdf_pct", *levels)
    )


def boxplots(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Quartiles, whiskers, mean and outlier count per label, highest median first."""
    run = run_keys(keys)
    by = [*run, "label"]
    whole = whole_group(by)
    levels = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = {name: quantile(p, whole) for name, p in levels.items()}
    reach = (F.col("q3") - F.col("q1")) * F.lit(anomalies.FENCE)
    inside = F.col("elapsed").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        ranked(histogram(samples, by), by)
        .withColumns(quartiles)
        .groupBy(*by)
        .agg(
            *[F.min(name).alias(name) for name in quartiles],
            F.min(F.when(inside, F.col("elapsed"))).alias("low_whisker"),
            F.max(F.when(inside, F.col("elapsed"))).alias("high_whisker"),
            mean_elapsed().alias("mean"),
            F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
        )
        .orderBy(*run, F.desc("median"), "label")
    )


def rt_heatmap(samples: DataFrame, b: int = 30, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Samples per bucket and response-time band, 0-filled, for bands the run has.

    keys, bucket, band, band_order, rows.
    """
    by = run_keys(keys)
    names = [name for _, name in RT_BANDS]
    banded = series.bucketed(samples, b).withColumn("band", rt_band("elapsed"))
    counts = banded.groupBy(*by, "bucket").agg(
        *[row_count(samples, F.col("band") == name).alias(name) for name in names]
    )
    cells = [
        f"struct('{name}' AS band, {i} AS band_order, `{name}` AS rows)"
        for i, name in enumerate(names)
    ]
    unfolded = counts.select(*by, "bucket", F.expr(f"inline(array({', '.join(cells)}))"))
    seen = F.max("rows").over(Window.partitionBy(*by, "band_order"))
    return unfolded.withColumn("seen", seen).filter("seen > 0").drop("seen")


def load_response(samples: DataFrame, b: int = 10, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """p90 against load: the buckets, their linear trend and the knee, by ``series``.

    keys, series (bucket, trend, knee), position (bucket or point number), rps, p90.
    """
    by = run_keys(keys)
    buckets = anomalies.rt_vs_throughput(samples, b, by).select(
        *by, F.lit("bucket").alias("series"), F.col("bucket_index").alias("position"), "rps", "p90"
    )
    trend = anomalies.linear_trend(samples, b, keys=by).select(
        *by, F.lit("trend").alias("series"), F.col("point").alias("position"), "rps", "p90"
    )
    bend = anomalies.knee(samples, by).select(
        *by,
        F.lit("knee").alias("series"),
        F.lit(0).alias("position"),
        F.col("knee_rps").alias("rps"),
        F.col("knee_p90_ms").alias("p90"),
    )
    return buckets.unionByName(trend).unionByName(bend)


def threads_error_grid(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """10 s buckets counted by mean threads (3 to 8 equal bins) and error-rate band.

    keys, thread_bin, threads_low, threads_high, error_band, error_order, buckets.  Bins
    are open on the right but for the last; equal thread counts all fall in the last bin.
    """
    by = run_keys(keys)
    needs_samples(samples)
    failed = row_count(samples, ~F.col("success"))
    buckets = (
        series.bucketed(samples, 10)
        .groupBy(*by, "bucket")
        .agg(
            F.avg("all_threads").alias("threads"),
            (failed / row_count(samples) * 100).alias("error_pct"),
        )
        .filter("threads is not null")
    )
    run = "OVER (PARTITION BY " + ", ".join(f"`{k}`" for k in by) + ")"
    ordered = run.replace(")", " ORDER BY threads)")
    sized = (
        buckets.selectExpr(
            "*",
            f"dense_rank() {ordered} AS kind",
            f"min(threads) {run} AS low",
            f"max(threads) {run} AS high",
        )
        .selectExpr("*", f"max(kind) {run} AS kinds")
        .selectExpr("*", f"least({THREAD_BINS_MAX}, greatest({THREAD_BINS_MIN}, kinds)) AS bins")
        .selectExpr("*", "(high - low) / bins AS width")
    )
    order = "CASE " + " ".join(
        f"WHEN error_pct < {edge!r}D THEN {i}" for i, edge in enumerate(ERROR_EDGES[1:-1])
    )
    placed = sized.selectExpr(
        *[f"`{k}`" for k in by],
        "bins",
        "low",
        "width",
        "size(filter(sequence(1, bins - 1), i -> threads >= i * width + low)) AS thread_bin",
        f"{order} ELSE {len(ERROR_BANDS) - 1} END AS error_order",
    )
    cells = [
        f"struct({i} AS thread_bin, '{band}' AS error_band, {j} AS error_order, "
        f"count_if(thread_bin = {i} AND error_order = {j}) AS buckets)"
        for i in range(THREAD_BINS_MAX)
        for j, band in enumerate(ERROR_BANDS)
    ]
    counts = placed.groupBy(*by, "bins", "low", "width").agg(
        F.expr(f"array({', '.join(cells)}) AS cells")
    )
    return (
        counts.selectExpr("*", "inline(cells)")
        .filter("thread_bin < bins")
        .selectExpr(
            *[f"`{k}`" for k in by],
            "thread_bin",
            "thread_bin * width + low AS threads_low",
            "thread_bin * width + low + width AS threads_high",
            "error_band",
            "error_order",
            "buckets",
        )
    )


def slowest_table(samples: DataFrame, n: int = 20, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The n slowest samples of each run, as printed."""
    by = run_keys(keys)
    return sampling.slowest(samples, n, by).select(
        *by,
        "place",
        time_text("timestamp_ms").alias("time"),
        "label",
        "elapsed",
        "response_code",
        short_url("url").alias("url"),
    )


def error_sunburst(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Failures by response code, and within it by label: keys, id, name, parent, value."""
    by = run_keys(keys)
    none = F.lit("None")
    counts = (
        samples.filter(is_error())
        .groupBy(
            *by,
            F.coalesce("response_code", none).alias("code"),
            F.coalesce("label", none).alias("label"),
        )
        .agg(row_count(samples).alias("rows"))
    )
    sets = counts.groupingSets([[*by, "code"], [*by, "code", "label"]], *by, "code", "label").agg(
        (F.grouping("label") == 1).alias("inner"), F.sum("rows").alias("value")
    )
    inner = F.col("inner")
    return sets.select(
        *by,
        F.when(inner, F.col("code")).otherwise(F.concat_ws("|", "code", "label")).alias("id"),
        F.when(inner, F.col("code")).otherwise(F.col("label")).alias("name"),
        F.when(inner, "").otherwise(F.col("code")).alias("parent"),
        "value",
    )


def variability(samples: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Mean, standard deviation and their ratio per label, most variable first."""
    by = run_keys(keys)
    needs_samples(samples)
    cv = F.when(F.col("mean") > 0, F.coalesce(F.col("std") / F.col("mean"), F.lit(0.0)))
    return (
        samples.groupBy(*by, "label")
        .agg(F.avg("elapsed").alias("mean"), F.stddev_samp("elapsed").alias("std"))
        .withColumn("cv", F.coalesce(cv, F.lit(0.0)))
        .withColumn("band", variability_band("cv"))
        .orderBy(*by, F.desc("cv"), "label")
    )


def apdex_by_label(samples: DataFrame, t: float = 0.5, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Apdex and rating per label, lowest score first."""
    return summary.apdex_bands(samples, t, keys).orderBy(*run_keys(keys), "apdex_score", "label")


# The chart names.
CHARTS: dict[str, Callable[..., DataFrame]] = {
    "fig-rt-scatter": rt_scatter,
    "fig-rt-time": anomalies.rt_over_time,
    "fig-percentile-fan": series.percentile_fan,
    "fig-throughput": series.total_throughput,
    "fig-errors": series.errors_by_code,
    "fig-threads": series.threads_vs_rt,
    "fig-bytes": series.transferred,
    "fig-sli-burn": series.sli_burn,
    "fig-transaction-mix": transaction_mix,
    "fig-connect-breakdown": series.connect_breakdown,
    "fig-throughput-efficiency": series.throughput_efficiency,
    "fig-steady-compare": segments.steady_compare,
    "fig-histogram": rt_histogram,
    "fig-cdf": rt_cdf,
    "fig-boxplots": boxplots,
    "fig-heatmap": rt_heatmap,
    "fig-outlier-scatter": outlier_scatter,
    "fig-rt-throughput": load_response,
    "fig-rt-concurrency": anomalies.rt_vs_concurrency,
    "fig-rt-status": rt_by_status,
    "fig-threads-error-heatmap": threads_error_grid,
    "fig-correlation": summary.correlations,
    "fig-components": series.latency_components,
    "fig-multiples": series.top_label_series,
    "fig-slo-gauges": slo.overall_gauges,
    "fig-apdex": apdex_by_label,
    "fig-slowest": slowest_table,
    "fig-sunburst": error_sunburst,
    "fig-variability": variability,
}
WITH_SLO = {"fig-sli-burn", "fig-slo-gauges"}


def chart(
    name: str,
    samples: DataFrame,
    slo_config: SloConfig | None = None,
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """The dataset of one chart, by its registered name."""
    options = {"slo": slo_config} if name in WITH_SLO else {}
    return CHARTS[name](samples, keys=keys, **options)


# Charts that need no column but those of a rollup, and buckets of a multiple of 5 s.
FROM_ROLLUP = {
    "fig-threads",
    "fig-bytes",
    "fig-rt-concurrency",
    "fig-rt-time",
    "fig-percentile-fan",
    "fig-throughput",
    "fig-errors",
    "fig-sli-burn",
    "fig-transaction-mix",
    "fig-histogram",
    "fig-cdf",
    "fig-boxplots",
    "fig-heatmap",
    "fig-rt-throughput",
    "fig-multiples",
    "fig-slo-gauges",
    "fig-apdex",
    "fig-sunburst",
}


def store_charts(
    samples: DataFrame,
    out: str,
    slo_config: SloConfig | None = None,
    rolled: DataFrame | None = None,
    keys: Sequence[str] = RUN_KEYS,
    at_once: int = 4,
    mode: str = "errorifexists",
) -> None:
    """Write every dataset as Parquet to ``out``/name, a few jobs at a time.

    Most charts read a rollup of the samples, ``rolled`` or else one stored here for all of them.
    """
    spark = samples.sparkSession
    rolled = settle(rollup(samples, keys=run_keys(keys))) if rolled is None else rolled

    def store(name: str) -> None:
        source = rolled if name in FROM_ROLLUP else samples
        chart(name, source, slo_config, keys).write.mode(mode).parquet(f"{out}/{name}")

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(inheritable_thread_target(spark)(store), CHARTS))
