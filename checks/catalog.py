"""Every operator as a query over the given tables, with its twin in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import inputs
from loadgauge.functions import columns as C
from loadgauge.functions import parsing as P
from loadgauge.model import SAMPLES_SCHEMA, SloConfig
from loadgauge.operators import (
    anomalies,
    charts,
    findings,
    sampling,
    segments,
    series,
    slo,
    summary,
)
from loadgauge.plans.histogram import rollup
from loadgauge.sources import cleaning, ingest, tables
from loadgauge.sources.csv_files import map_columns
from loadgauge.sources.detect import classify_inputs
from loadgauge.sources.xml_files import read_jtl_xml
from loadgauge.streaming import live

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    query: Query
    oracle: str | None


CHECKS: dict[str, Check] = {}


def comparable(df: DataFrame, texts: str = "") -> DataFrame:
    """Doubles rounded to 6 places, times as epoch numbers, ``texts`` as strings."""
    shown = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if field.name in texts.split():
            column = column.cast("string")
        elif isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, T.TimestampType):
            seconds = field.name == "bucket"
            column = F.unix_seconds(column) if seconds else F.unix_millis(column)
        shown.append(column.alias(field.name))
    return df.select(*shown)


def check(
    name: str,
    query: Callable[[DataFrame], DataFrame],
    sql: str | None,
    doubles: str = "",
    kind: str = "base",
    texts: str = "",
) -> None:
    """Register query(samples), and SQL over a table ``samples`` whose doubles are rounded.

    ``texts`` are numbers and truth values that may be null; data frames of different
    engines show such columns differently, so they are compared as text.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return comparable(query(inputs.samples(spark, sf_dir, kind)), texts)

    if sql is not None:
        # Adding zero turns -0.0, which only one engine gives, into 0.0.
        changed = [f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split()]
        changed += [f"CAST({c} AS VARCHAR) AS {c}" for c in texts.split()]
        shown = f"* REPLACE ({', '.join(changed)})" if changed else "*"
        sql = f"WITH samples AS ({inputs.duckdb_samples(kind)}) SELECT {shown} FROM ({sql}) result"
    CHECKS[name] = Check(run, sql)


def bucket(seconds: int) -> str:
    return f"(timestamp_ms // 1000 // {seconds}) * {seconds} AS bucket"


def quantiles(*levels: float) -> str:
    named = {0.999: "p999"}
    return ", ".join(
        f"quantile_cont(elapsed, {p}) AS {named.get(p, f'p{round(p * 100)}')}" for p in levels
    )


ERRORS = "CAST(coalesce(sum(CASE WHEN NOT success THEN 1 ELSE 0 END), 0) AS BIGINT)"

# ---- summaries -----------------------------------------------------------------------

PERCENTILE_SQL = f"""SELECT run_id, {{label}} count(*) AS count, avg(elapsed) AS mean,
    stddev_samp(elapsed) AS std, min(elapsed) AS min, max(elapsed) AS max,
    {quantiles(0.5, 0.75, 0.9, 0.95, 0.99, 0.999)} FROM samples GROUP BY run_id{{group}}"""
PERCENTILE_DOUBLES = "mean std p50 p75 p90 p95 p99 p999"
check(
    "a1_percentiles",
    summary.percentiles,
    PERCENTILE_SQL.format(label="label,", group=", label"),
    PERCENTILE_DOUBLES,
)
check(
    "a1_percentiles_all_labels",
    lambda s: summary.percentiles(s, by_label=False),
    PERCENTILE_SQL.format(label="", group=""),
    PERCENTILE_DOUBLES,
)
check(
    "a2_overall_percentiles",
    summary.overall_percentiles,
    f"SELECT run_id, {quantiles(0.5, 0.75, 0.9, 0.95, 0.99, 0.999)} FROM samples GROUP BY run_id",
    "p50 p75 p90 p95 p99 p999",
)
LABEL_AGGREGATE = f"""SELECT run_id, label, count(*) AS count, avg(elapsed) AS mean_elapsed,
    {quantiles(0.5, 0.9, 0.95, 0.99)}, {ERRORS} * 1.0 / count(*) AS error_rate,
    min(elapsed) AS min_elapsed, max(elapsed) AS max_elapsed
    FROM {{source}} GROUP BY run_id, label"""
check(
    "a3_label_aggregate",
    summary.label_aggregate,
    LABEL_AGGREGATE.format(source="samples"),
    "mean_elapsed p50 p90 p95 p99 error_rate",
    "stressed",
)
LABEL_SUMMARY = f"""SELECT run_id, label, count(*) AS count, {ERRORS} AS error_count,
    {ERRORS} * 1.0 / count(*) AS error_rate, avg(elapsed) AS mean_elapsed,
    {quantiles(0.5, 0.9, 0.95, 0.99)}, min(elapsed) AS min_elapsed, max(elapsed) AS max_elapsed,
    avg(bytes) AS mean_bytes, avg(latency) AS mean_latency, avg(connect) AS mean_connect
    FROM samples GROUP BY run_id, label"""
LABEL_SUMMARY_DOUBLES = (
    "error_rate mean_elapsed p50 p90 p95 p99 mean_bytes mean_latency mean_connect"
)
check("a4_label_summary", summary.label_summary, LABEL_SUMMARY, LABEL_SUMMARY_DOUBLES)


def _correlation_sql() -> str:
    cells = []
    for a in summary.CORRELATED:
        for b in summary.CORRELATED:
            r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            cells.append(
                f"SELECT run_id, '{a}' AS col_a, '{b}' AS col_b, CASE WHEN {r} IS NULL OR "
                f"isnan({r}) THEN 0.0 ELSE {r} END AS correlation FROM samples GROUP BY run_id"
            )
    return " UNION ALL ".join(cells)


check("a10_correlations", summary.correlations, _correlation_sql(), "correlation")
check("f22_correlation", lambda s: charts.chart("fig-correlation", s), _correlation_sql(), "correlation")

APDEX = """SELECT run_id, label,
    CAST(sum(CASE WHEN elapsed <= 500 THEN 1 ELSE 0 END) AS BIGINT) AS satisfied,
    CAST(sum(CASE WHEN elapsed > 500 AND elapsed <= 2000 THEN 1 ELSE 0 END) AS BIGINT)
        AS tolerating,
    CAST(sum(CASE WHEN elapsed > 2000 THEN 1 ELSE 0 END) AS BIGINT) AS frustrated,
    count(*) AS total,
    sum(CASE WHEN elapsed <= 500 THEN 1.0 WHEN elapsed <= 2000 THEN 0.5 ELSE 0 END)::DOUBLE
        / count(*) AS apdex_score
    FROM samples GROUP BY run_id, label"""
BANDED_APDEX = f"""SELECT *, CASE WHEN apdex_score >= 0.85 THEN 'good'
    WHEN apdex_score >= 0.7 THEN 'fair' ELSE 'poor' END AS band FROM ({APDEX}) a"""
check("a11_apdex", summary.apdex, APDEX, "apdex_score")
check("c11_apdex_band", summary.apdex_bands, BANDED_APDEX, "apdex_score")
check("f26_apdex", lambda s: charts.chart("fig-apdex", s), BANDED_APDEX, "apdex_score")

# ---- series --------------------------------------------------------------------------

ALL_RATE = f"SELECT run_id, {bucket(5)}, count(*) / 5.0 AS rps FROM samples GROUP BY run_id, bucket"
check(
    "a5_throughput",
    series.throughput,
    f"""SELECT run_id, bucket, 'ALL' AS label, TRUE AS is_total, rps FROM ({ALL_RATE}) t
    UNION ALL SELECT run_id, {bucket(5)}, label, FALSE AS is_total, count(*) / 5.0 AS rps
    FROM samples GROUP BY run_id, bucket, label""",
    "rps",
)
check("f4_throughput", lambda s: charts.chart("fig-throughput", s), ALL_RATE, "rps")
check(
    "a6_errors",
    series.errors,
    f"""WITH b AS (SELECT *, {bucket(5)} FROM samples),
    t AS (SELECT run_id, bucket, {ERRORS} AS error_count, count(*) AS total_count,
        {ERRORS} * 1.0 / count(*) AS error_rate FROM b GROUP BY run_id, bucket),
    c AS (SELECT run_id, bucket, response_code, count(*) AS n FROM b WHERE NOT success
        GROUP BY run_id, bucket, response_code),
    m AS (SELECT *, row_number() OVER (PARTITION BY run_id, bucket
        ORDER BY n DESC, response_code) AS place FROM c)
    SELECT t.*, m.response_code FROM t LEFT JOIN m
    ON t.run_id = m.run_id AND t.bucket = m.bucket AND m.place = 1""",
    "error_rate",
    "stressed",
)
check(
    "a7_rt_series",
    series.rt_series,
    f"""SELECT run_id, {bucket(5)}, label, {quantiles(0.5, 0.9, 0.95, 0.99)},
    avg(elapsed) AS mean, min(elapsed) AS min, max(elapsed) AS max
    FROM samples GROUP BY run_id, bucket, label""",
    "p50 p90 p95 p99 mean",
)
check(
    "a8_threads",
    series.threads,
    f"""SELECT run_id, {bucket(5)}, max(grp_threads) AS grp_threads,
    max(all_threads) AS all_threads FROM samples GROUP BY run_id, bucket""",
)
BYTES = f"""SELECT run_id, {bucket(5)}, CAST(sum(bytes) AS BIGINT) AS total_bytes,
    CAST(sum(sent_bytes) AS BIGINT) AS total_sent_bytes, sum(bytes) / 5.0 AS bytes_per_sec
    FROM samples GROUP BY run_id, bucket"""
check("a9_bytes", series.transferred, BYTES, "bytes_per_sec")
check("f7_bytes", lambda s: charts.chart("fig-bytes", s), BYTES, "bytes_per_sec")
check(
    "f3_percentile_fan",
    series.percentile_fan,
    f"""SELECT run_id, {bucket(5)}, {quantiles(0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)}
    FROM samples GROUP BY run_id, bucket""",
    "p50 p60 p70 p80 p90 p95 p99",
)
check(
    "f5_errors_by_code",
    series.errors_by_code,
    f"""WITH b AS (SELECT *, {bucket(5)} FROM samples)
    SELECT run_id, bucket, TRUE AS is_total, NULL AS response_code, {ERRORS} AS error_count,
        count(*) AS total_count, {ERRORS} * 100.0 / count(*) AS error_rate_pct
    FROM b GROUP BY run_id, bucket
    UNION ALL SELECT run_id, bucket, FALSE, response_code, count(*), NULL, NULL
    FROM b WHERE NOT success GROUP BY run_id, bucket, response_code""",
    "error_rate_pct",
    "stressed",
    texts="total_count",
)
check(
    "f6_threads_vs_rt",
    series.threads_vs_rt,
    f"""SELECT run_id, {bucket(5)}, max(all_threads) AS all_threads, {quantiles(0.9)}
    FROM samples GROUP BY run_id, bucket""",
    "p90",
)
check(
    "f8_sli_burn",
    series.sli_burn,
    f"""SELECT *, 1.0::DOUBLE AS error_threshold_pct, 3000.0::DOUBLE AS p99_threshold_ms,
    error_rate_pct > 1.0 AS error_breach, p99 > 3000.0 AS p99_breach
    FROM (SELECT run_id, {bucket(10)}, {ERRORS} * 100.0 / count(*) AS error_rate_pct,
    {quantiles(0.99)} FROM samples GROUP BY run_id, bucket) b""",
    "error_rate_pct p99",
    "stressed",
)
check(
    "f10_connect_breakdown",
    series.connect_breakdown,
    f"""SELECT run_id, {bucket(10)}, avg(connect) AS connect, avg(latency) AS latency,
    avg(idle_time) AS idle_time FROM samples GROUP BY run_id, bucket""",
    "connect latency idle_time",
)
check(
    "f11_throughput_efficiency",
    series.throughput_efficiency,
    f"""SELECT run_id, {bucket(10)}, CASE WHEN sum(elapsed) = 0 THEN 0.0
    ELSE (sum(bytes) + sum(sent_bytes)) / sum(elapsed) END AS bytes_per_ms
    FROM samples GROUP BY run_id, bucket""",
    "bytes_per_ms",
)
TRANSFER = "greatest(elapsed - latency - connect - idle_time, 0)"
check(
    "f23_latency_components",
    series.latency_components,
    f"""SELECT run_id, {bucket(10)}, avg(connect) AS connect_mean, avg(latency) AS latency_mean,
    avg({TRANSFER}) AS transfer_mean FROM samples GROUP BY run_id, bucket""",
    "connect_mean latency_mean transfer_mean",
)
check(
    "f24_top_label_series",
    lambda s: series.top_label_series(s, labels=3),
    f"""WITH v AS (SELECT run_id, label, row_number() OVER (PARTITION BY run_id
        ORDER BY count(*) DESC, label) AS place FROM samples GROUP BY run_id, label)
    SELECT s.run_id, {bucket(10)}, s.label, {quantiles(0.9)} FROM samples s JOIN v
    ON s.run_id = v.run_id AND s.label = v.label AND v.place <= 3
    GROUP BY s.run_id, bucket, s.label""",
    "p90",
)
check(
    "f30_label_errors",
    series.label_errors,
    f"""SELECT run_id, {bucket(10)}, label, {ERRORS} AS error_count, count(*) AS total_count,
    {ERRORS} * 1.0 / count(*) AS error_rate FROM samples GROUP BY run_id, bucket, label""",
    "error_rate",
    "stressed",
)

# ---- segments and anomalies ------------------------------------------------------------

WARMUP = f"""SELECT run_id, start_ms,
    least(busy_ms, CAST(trunc(start_ms + (test_end_ms - start_ms) * 0.5::DOUBLE) AS BIGINT))
        AS warmup_end_ms, test_end_ms
    FROM (SELECT run_id, min(first) AS start_ms, max(last) + max(longest) AS test_end_ms,
        min(CASE WHEN rows / 5.0 >= peak / 5.0 * 0.8 THEN bucket * 1000 END) AS busy_ms
        FROM (SELECT *, max(rows) OVER (PARTITION BY run_id) AS peak
            FROM (SELECT run_id, {bucket(5)}, count(*) AS rows, min(timestamp_ms) AS first,
                max(timestamp_ms) AS last, max(elapsed) AS longest
                FROM samples GROUP BY run_id, bucket) b) p GROUP BY run_id) w"""
STEADY = f"""SELECT s.* FROM samples s JOIN ({WARMUP}) w ON s.run_id = w.run_id
    AND s.timestamp_ms >= w.warmup_end_ms AND s.timestamp_ms <= w.test_end_ms"""
check("w4_warmup", segments.warmup, WARMUP)
check("w5_steady", lambda s: segments.steady(s), STEADY)
check(
    "f12_steady_compare",
    lambda s: segments.steady_compare(s),
    f"""WITH p AS (SELECT s.run_id, elapsed, CASE WHEN timestamp_ms < warmup_end_ms THEN 'Warmup'
        WHEN timestamp_ms <= test_end_ms THEN 'Steady' END AS phase
        FROM samples s JOIN ({WARMUP}) w ON s.run_id = w.run_id),
    q AS (SELECT run_id, phase, {quantiles(0.9, 0.99)} FROM p GROUP BY run_id, phase)
    SELECT g.run_id, g.phase, coalesce(p90, 0.0) AS p90, coalesce(p99, 0.0) AS p99
    FROM (SELECT DISTINCT run_id, unnest(['Warmup', 'Steady']) AS phase FROM samples) g
    LEFT JOIN q ON g.run_id = q.run_id AND g.phase = q.phase""",
    "p90 p99",
)


def _z_sql(inner: str) -> str:
    return f"""SELECT *, CASE WHEN std > 0 THEN (p95 - mean) / std ELSE 0.0 END AS z_score FROM
    (SELECT *, avg(p95) OVER (PARTITION BY run_id) AS mean,
        stddev_samp(p95) OVER (PARTITION BY run_id) AS std FROM ({inner}) i) z"""


P95 = f"SELECT run_id, {bucket(10)}, {quantiles(0.95)} FROM samples GROUP BY run_id, bucket"
check(
    "w1_rt_spikes",
    anomalies.rt_spikes,
    f"SELECT run_id, bucket, p95, z_score, abs(z_score) > 3 AS is_anomaly FROM ({_z_sql(P95)}) r",
    "p95 z_score",
    "stressed",
)
RT_TIME = f"""SELECT run_id, {bucket(5)}, {quantiles(0.5, 0.9, 0.95, 0.99)}
    FROM samples GROUP BY run_id, bucket"""
check(
    "f2_rt_over_time",
    anomalies.rt_over_time,
    f"""SELECT run_id, bucket, p50, p90, p95, p99, abs(z_score) > 3 AS is_anomaly
    FROM ({_z_sql(RT_TIME)}) r""",
    "p50 p90 p95 p99",
    "stressed",
)
check(
    "w2_error_spikes",
    anomalies.error_spikes,
    f"""SELECT run_id, bucket, error_count, total_count, error_rate FROM
    (SELECT *, avg(error_rate) OVER (PARTITION BY run_id) AS mean FROM
        (SELECT run_id, {bucket(10)}, {ERRORS} AS error_count, count(*) AS total_count,
        {ERRORS} * 1.0 / count(*) AS error_rate FROM samples GROUP BY run_id, bucket) b) m
    WHERE error_rate > 0.05 AND error_rate > 2 * greatest(mean, 0.001)""",
    "error_rate",
    "stressed",
)
LOAD = f"""SELECT run_id, {bucket(10)}, count(*) / 10.0 AS rps, {quantiles(0.9)}
    FROM samples GROUP BY run_id, bucket"""
KNEE = f"""WITH o AS (SELECT *, row_number() OVER w AS i, p90 - lag(p90) OVER w AS delta,
        count(*) OVER (PARTITION BY run_id) AS size FROM ({LOAD}) l
        WINDOW w AS (PARTITION BY run_id ORDER BY rps, bucket)),
    n AS (SELECT *, greatest(1, size // 4) AS n FROM o),
    k AS (SELECT *, greatest(sum(CASE WHEN i <= n + 1 THEN delta END)
            OVER (PARTITION BY run_id) / n, 0.1) AS slope,
        sum(CASE WHEN i <= n THEN p90 END) OVER (PARTITION BY run_id) / n AS rt FROM n)
    SELECT run_id, min_by(rps, i) AS knee_rps, min_by(p90, i) AS knee_p90_ms FROM k
    WHERE size >= 3 AND delta > 2 * slope AND p90 > 2 * rt GROUP BY run_id"""
check("w3_knee", anomalies.knee, KNEE, "knee_rps knee_p90_ms", "stressed")
check("w3_rate_vs_p90", anomalies.rate_vs_p90, LOAD, "rps p90")
INDEXED = f"""SELECT run_id, bucket, CAST(row_number() OVER (PARTITION BY run_id ORDER BY bucket)
    - 1 AS INTEGER) AS bucket_index, rps, p90 FROM ({LOAD}) l"""
check("w7_bucket_index", anomalies.rt_vs_throughput, INDEXED, "rps p90")
TREND = f"""SELECT run_id, CAST(point AS INTEGER) AS point, rps,
    slope * rps + intercept AS p90 FROM
    (SELECT run_id, point, slope, intercept, low + (high - low) * point / 99.0 AS rps FROM
        (SELECT run_id, regr_slope(p90, rps) AS slope, regr_intercept(p90, rps) AS intercept,
        min(rps) AS low, max(rps) AS high FROM ({LOAD}) l GROUP BY run_id) f,
        range(100) r(point) WHERE high > low) t"""
check("w8_linear_trend", anomalies.linear_trend, TREND, "rps p90", "stressed")
check(
    "f18_load_response",
    charts.load_response,
    f"""SELECT run_id, 'bucket' AS series, bucket_index AS position, rps, p90 FROM ({INDEXED}) a
    UNION ALL SELECT run_id, 'trend', point, rps, p90 FROM ({TREND}) b
    UNION ALL SELECT run_id, 'knee', CAST(0 AS INTEGER), knee_rps, knee_p90_ms FROM ({KNEE}) c""",
    "rps p90",
    "stressed",
)
check(
    "f19_rt_vs_concurrency",
    anomalies.rt_vs_concurrency,
    f"""SELECT run_id, bucket, CAST(row_number() OVER (PARTITION BY run_id ORDER BY bucket) - 1
    AS INTEGER) AS bucket_index, threads, p90 FROM (SELECT run_id, {bucket(10)},
    max(all_threads) AS threads, {quantiles(0.9)} FROM samples GROUP BY run_id, bucket) b""",
    "p90",
)
FENCES = """SELECT run_id, label, q1 - 1.5 * (q3 - q1) AS low_fence,
    q3 + 1.5 * (q3 - q1) AS high_fence FROM
    (SELECT run_id, label, CAST(min(CASE WHEN i = round((n - 1) * 0.25) + 1 THEN elapsed END)
            AS DOUBLE) AS q1,
        CAST(min(CASE WHEN i = round((n - 1) * 0.75) + 1 THEN elapsed END) AS DOUBLE) AS q3
    FROM (SELECT run_id, label, elapsed,
        row_number() OVER (PARTITION BY run_id, label ORDER BY elapsed) AS i,
        count(*) OVER (PARTITION BY run_id, label) AS n FROM samples) r GROUP BY run_id, label) q"""
check("w6_iqr_fences", anomalies.iqr_fences, FENCES, "low_fence high_fence")
OUTLIERS = f"""SELECT s.*, elapsed < low_fence OR elapsed > high_fence AS is_outlier
    FROM samples s JOIN ({FENCES}) f ON s.run_id = f.run_id AND s.label = f.label"""
check("w6_iqr_outliers", lambda s: anomalies.iqr_outliers(s), OUTLIERS)
MIX = f"""SELECT run_id, bucket, label, rows, rows * 100.0
    / sum(rows) OVER (PARTITION BY run_id, bucket) AS share_pct
    FROM (SELECT run_id, {bucket(10)}, label, count(*) AS rows FROM samples
    GROUP BY run_id, bucket, label) c"""
check("w9_label_mix", anomalies.label_mix, MIX, "share_pct")
check(
    "f9_transaction_mix",
    charts.transaction_mix,
    f"""WITH m AS ({MIX}), b AS (SELECT DISTINCT run_id, bucket FROM m),
    l AS (SELECT DISTINCT run_id, label FROM m)
    SELECT b.run_id, b.bucket, l.label, coalesce(m.share_pct, 0.0) AS share_pct
    FROM b JOIN l ON b.run_id = l.run_id LEFT JOIN m
    ON m.run_id = b.run_id AND m.bucket = b.bucket AND m.label = l.label""",
    "share_pct",
)

# ---- SLO and findings ------------------------------------------------------------------

STEADY_METRICS = f"""SELECT run_id, label, quantile_cont(elapsed, 0.9) AS p90_ms,
    quantile_cont(elapsed, 0.99) AS p99_ms, {ERRORS} * 100.0 / count(*) AS error_rate_pct,
    sum(CASE WHEN elapsed <= 500 THEN 1.0 WHEN elapsed <= 2000 THEN 0.5 ELSE 0 END)::DOUBLE
        / count(*) AS apdex_score FROM ({STEADY}) s GROUP BY run_id, label"""
check(
    "e1_steady_metrics",
    lambda s: slo.steady_metrics(s),
    f"""SELECT run_id, label, p90_ms AS p90, p99_ms AS p99, error_rate_pct
    FROM ({STEADY_METRICS}) m""",
    "p90 p99 error_rate_pct",
    "stressed",
)


def _slo_sql(p90: float, p99: float, rate: float) -> str:
    return f"""SELECT *, p90_compliant AND p99_compliant AND error_rate_compliant
    AS overall_compliant FROM (SELECT *, p90_ms <= {p90} AS p90_compliant,
    p99_ms <= {p99} AS p99_compliant, error_rate_pct <= {rate} AS error_rate_compliant
    FROM ({STEADY_METRICS}) m) c"""


SLO = _slo_sql(1000, 3000, 1)
LOOSE = SloConfig(p90_ms=1130.0, p99_ms=2300.0, error_rate_pct=20.0)
SLO_DOUBLES = "p90_ms p99_ms error_rate_pct apdex_score"
check("e3_slo_compliance", lambda s: slo.slo_compliance(s), SLO, SLO_DOUBLES, "stressed")
check(
    "e3_slo_compliance_loose",
    lambda s: slo.slo_compliance(s, LOOSE),
    _slo_sql(1130, 2300, 20),
    SLO_DOUBLES,
)
check(
    "a12_run_kpis",
    lambda s: slo.run_kpis(s),
    f"""WITH o AS (SELECT run_id, {quantiles(0.5, 0.9, 0.99)}, count(*) AS samples
        FROM samples GROUP BY run_id),
    r AS (SELECT run_id, avg(rate) * 100 AS rate FROM (SELECT run_id, label,
        {ERRORS} * 1.0 / count(*) AS rate FROM samples GROUP BY run_id, label) l GROUP BY run_id),
    v AS (SELECT run_id, bool_and(overall_compliant) AS passes FROM ({SLO}) s GROUP BY run_id)
    SELECT o.run_id, p50, p90, p99, rate AS mean_label_error_rate_pct,
    CASE WHEN coalesce(passes, TRUE) THEN 'PASS' ELSE 'FAIL' END AS slo_status, samples
    FROM o JOIN r ON o.run_id = r.run_id LEFT JOIN v ON o.run_id = v.run_id""",
    "p50 p90 p99 mean_label_error_rate_pct",
    "stressed",
)
GAUGES = f"""SELECT *, CASE WHEN apdex_score >= 0.85 THEN 'good' WHEN apdex_score >= 0.7
    THEN 'fair' ELSE 'poor' END AS apdex_band, error_rate_pct <= 1 AS error_rate_ok,
    p99_ms <= 3000 AS p99_ok FROM
    (SELECT a.run_id, apdex_score, error_rate_pct, p99_ms FROM
        (SELECT run_id, sum(apdex_score * total) / sum(total) AS apdex_score
        FROM ({APDEX}) x GROUP BY run_id) a JOIN
        (SELECT run_id, {ERRORS} * 100.0 / count(*) AS error_rate_pct,
        quantile_cont(elapsed, 0.99) AS p99_ms FROM samples GROUP BY run_id) e
        ON a.run_id = e.run_id) g"""
GAUGE_DOUBLES = "apdex_score error_rate_pct p99_ms"
check("a13_overall_gauges", slo.overall_gauges, GAUGES, GAUGE_DOUBLES, "stressed")
check("f25_slo_gauges", lambda s: charts.chart("fig-slo-gauges", s), GAUGES, GAUGE_DOUBLES)


def figures(found: DataFrame) -> DataFrame:
    """Findings without their text, one row per figure in data."""
    return found.select("run_id", "kind", "severity", "label", F.explode("data").alias("name", "value"))


def _figures_sql(rows: str, kind: str, severity: str, names: list[str], label: str = "NULL") -> str:
    return " UNION ALL ".join(
        f"SELECT run_id, '{kind}' AS kind, {severity} AS severity, CAST({label} AS VARCHAR) AS label, "
        f"'{name}' AS name, CAST({name} AS DOUBLE) AS value FROM ({rows}) f"
        for name in names
    )


TAIL = f"""SELECT *, p99 / greatest(p50, 1.0) AS ratio FROM (SELECT run_id, label,
    CASE WHEN p50 = 0 THEN 1.0 ELSE p50 END AS p50, p99 FROM (SELECT run_id, label,
    {quantiles(0.5, 0.99)} FROM samples GROUP BY run_id, label) q) t"""
CV = """SELECT *, std / greatest(mean, 1.0) AS cv FROM (SELECT run_id, label,
    avg(elapsed) AS mean, stddev_samp(elapsed) AS std FROM samples GROUP BY run_id, label) q"""
SPIKE = f"""SELECT run_id, max(error_rate) AS max_error_rate FROM (SELECT run_id, {bucket(10)},
    {ERRORS} * 1.0 / count(*) AS error_rate FROM samples GROUP BY run_id, bucket) b GROUP BY run_id"""
COLD = """SELECT s.run_id,
    sum(CASE WHEN timestamp_ms < first + 30000 AND NOT success THEN 1 ELSE 0 END) * 1.0
        / sum(CASE WHEN timestamp_ms < first + 30000 THEN 1 ELSE 0 END) AS first_30s_error_rate,
    sum(CASE WHEN NOT success THEN 1 ELSE 0 END) * 1.0 / count(*) AS overall_error_rate
    FROM samples s JOIN (SELECT run_id, min(timestamp_ms) AS first FROM samples GROUP BY run_id) m
    ON s.run_id = m.run_id GROUP BY s.run_id"""
RULES = {
    "e4_tail_latency": (
        lambda s: findings.tail_latency(s),
        _figures_sql(
            f"SELECT * FROM ({TAIL}) x WHERE ratio > 5",
            "tail_latency_ratio",
            "CASE WHEN ratio > 10 THEN 'critical' ELSE 'warning' END",
            ["ratio", "p50", "p99"],
            "label",
        ),
    ),
    "e5_saturation_knee": (
        lambda s: findings.saturation_knee(s),
        _figures_sql(KNEE, "saturation_knee", "'warning'", ["knee_rps", "knee_p90_ms"]),
    ),
    "e6_error_spike": (
        lambda s: findings.error_spike(s),
        _figures_sql(
            f"SELECT * FROM ({SPIKE}) x WHERE max_error_rate > 0.1",
            "error_spike",
            "'critical'",
            ["max_error_rate"],
        ),
    ),
    "e7_slo_violation": (
        lambda s: findings.slo_violation(s),
        _figures_sql(
            f"SELECT * FROM ({SLO}) x WHERE NOT overall_compliant",
            "slo_violation",
            "'critical'",
            ["p90_ms", "p99_ms", "error_rate_pct"],
            "label",
        ),
    ),
    "e8_warmup_window": (
        lambda s: findings.warmup_window(s),
        _figures_sql(
            f"SELECT *, (warmup_end_ms - start_ms) / 1000.0 AS warmup_duration_s FROM ({WARMUP}) x",
            "warmup_window",
            "'info'",
            ["warmup_duration_s", "warmup_end_ms"],
        ),
    ),
    "e9_high_variability": (
        lambda s: findings.high_variability(s),
        _figures_sql(
            f"SELECT * FROM ({CV}) x WHERE cv > 1",
            "high_variability",
            "'warning'",
            ["cv", "mean", "std"],
            "label",
        ),
    ),
    "e10_cold_start": (
        lambda s: findings.cold_start(s),
        _figures_sql(
            f"""SELECT * FROM ({COLD}) x WHERE first_30s_error_rate > 2 * overall_error_rate
            AND first_30s_error_rate > 0.01""",
            "cold_start_detected",
            "'info'",
            ["first_30s_error_rate", "overall_error_rate"],
        ),
    ),
}
for _name, (_rule, _sql) in RULES.items():
    check(_name, lambda s, rule=_rule: figures(rule(s)), _sql, "value", "stressed")
check(
    "e11_findings",
    lambda s: figures(findings.findings(s)),
    " UNION ALL ".join(f"SELECT * FROM ({sql}) r" for _, sql in RULES.values()),
    "value",
    "stressed",
)

# ---- charts ------------------------------------------------------------------------------

SPREAD = "SELECT run_id, min(elapsed) AS lo, max(elapsed) AS hi FROM samples {where} GROUP BY run_id"


def _histogram_sql(where: str = "") -> str:
    return f"""WITH m AS ({SPREAD.format(where=where)}),
    c AS (SELECT s.run_id, least(49, CAST(floor(CASE WHEN hi = lo THEN 0 ELSE
        (elapsed - lo) * 50::DOUBLE / (hi - lo) END) AS INTEGER)) AS bin, count(*) AS n
        FROM samples s JOIN m ON s.run_id = m.run_id {where} GROUP BY s.run_id, bin),
    q AS (SELECT run_id, {quantiles(0.5, 0.9, 0.99)} FROM samples {where} GROUP BY run_id)
    SELECT m.run_id, CAST(i AS INTEGER) AS bin, lo + (hi - lo) / 50.0 * i AS low,
    lo + (hi - lo) / 50.0 * (i + 1) AS high, coalesce(n, 0) AS rows, p50, p90, p99
    FROM m JOIN q ON m.run_id = q.run_id CROSS JOIN range(50) r(i)
    LEFT JOIN c ON c.run_id = m.run_id AND c.bin = i"""


HISTOGRAM_DOUBLES = "low high p50 p90 p99"
check("f13_histogram", charts.rt_histogram, _histogram_sql(), HISTOGRAM_DOUBLES)
check(
    "c14_label_histogram",
    lambda s: charts.rt_histogram(s, label="Transaction 2"),
    _histogram_sql("WHERE label = 'Transaction 2'"),
    HISTOGRAM_DOUBLES,
)
check(
    "f14_cdf",
    lambda s: charts.rt_cdf(s, points=700),
    f"""WITH o AS (SELECT run_id, elapsed,
        row_number() OVER (PARTITION BY run_id ORDER BY elapsed) - 1 AS i,
        greatest(1, count(*) OVER (PARTITION BY run_id) // 700) AS step FROM samples),
    k AS (SELECT *, i // step AS point, count(*) OVER (PARTITION BY run_id) AS kept
        FROM o WHERE i % step = 0),
    q AS (SELECT run_id, {quantiles(0.9, 0.95, 0.99)} FROM samples GROUP BY run_id)
    SELECT k.run_id, point, elapsed, (point + 1) * 100.0 / kept AS cdf_pct, p90, p95, p99
    FROM k JOIN q ON k.run_id = q.run_id""",
    "cdf_pct p90 p95 p99",
)
check(
    "f15_boxplots",
    charts.boxplots,
    """WITH q AS (SELECT run_id, label, quantile_cont(elapsed, 0.25) AS q1,
        quantile_cont(elapsed, 0.5) AS median, quantile_cont(elapsed, 0.75) AS q3
        FROM samples GROUP BY run_id, label),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT s.run_id, s.label, min(q1) AS q1, min(median) AS median, min(q3) AS q3,
    min(CASE WHEN elapsed BETWEEN lo AND hi THEN elapsed END) AS low_whisker,
    max(CASE WHEN elapsed BETWEEN lo AND hi THEN elapsed END) AS high_whisker,
    avg(elapsed) AS mean,
    CAST(sum(CASE WHEN elapsed BETWEEN lo AND hi THEN 0 ELSE 1 END) AS BIGINT) AS outliers
    FROM samples s JOIN f ON s.run_id = f.run_id AND s.label = f.label
    GROUP BY s.run_id, s.label""",
    "q1 median q3 mean",
)
BAND = """CASE WHEN elapsed < 100 THEN 0 WHEN elapsed < 250 THEN 1 WHEN elapsed < 500 THEN 2
    WHEN elapsed < 1000 THEN 3 WHEN elapsed < 2000 THEN 4 WHEN elapsed < 5000 THEN 5 ELSE 6 END"""
BAND_NAMES = "['0-100', '100-250', '250-500', '500-1k', '1k-2k', '2k-5k', '5k+']"
check(
    "f16_heatmap",
    charts.rt_heatmap,
    f"""WITH c AS (SELECT run_id, {bucket(30)}, {BAND} AS band_order, count(*) AS n
        FROM samples GROUP BY run_id, bucket, band_order),
    t AS (SELECT DISTINCT run_id, bucket FROM c), b AS (SELECT DISTINCT run_id, band_order FROM c)
    SELECT t.run_id, t.bucket, {BAND_NAMES}[b.band_order + 1] AS band, b.band_order,
    coalesce(n, 0) AS rows FROM t JOIN b ON t.run_id = b.run_id
    LEFT JOIN c ON c.run_id = t.run_id AND c.bucket = t.bucket AND c.band_order = b.band_order""",
)


def _grid_sql() -> str:
    bounded = " + ".join(
        f"CASE WHEN {i} < bins AND threads >= {i} * width + lo THEN 1 ELSE 0 END" for i in range(1, 8)
    )
    return f"""WITH b AS (SELECT run_id, {bucket(10)}, avg(all_threads) AS threads,
        {ERRORS} * 1.0 / count(*) * 100 AS pct FROM samples GROUP BY run_id, bucket),
    m AS (SELECT run_id, min(threads) AS lo, max(threads) AS hi,
        least(8, greatest(3, count(DISTINCT threads))) AS bins FROM b GROUP BY run_id),
    w AS (SELECT *, (hi - lo) / bins AS width FROM m),
    p AS (SELECT b.run_id, {bounded} AS thread_bin, CASE WHEN pct < 0.01 THEN 0 WHEN pct < 1 THEN 1
        WHEN pct < 5 THEN 2 WHEN pct < 25 THEN 3 ELSE 4 END AS error_order
        FROM b JOIN w ON b.run_id = w.run_id),
    c AS (SELECT run_id, thread_bin, error_order, count(*) AS n FROM p
        GROUP BY run_id, thread_bin, error_order)
    SELECT w.run_id, CAST(i AS INTEGER) AS thread_bin, i * width + lo AS threads_low,
    i * width + lo + width AS threads_high,
    ['≈0%', '0–1%', '1–5%', '5–25%', '>25%'][j + 1] AS error_band,
    CAST(j AS INTEGER) AS error_order, coalesce(n, 0) AS buckets
    FROM w CROSS JOIN range(8) x(i) CROSS JOIN range(5) y(j)
    LEFT JOIN c ON c.run_id = w.run_id AND c.thread_bin = i AND c.error_order = j WHERE i < bins"""


check(
    "f21_threads_error_grid",
    charts.threads_error_grid,
    _grid_sql(),
    "threads_low threads_high",
    "stressed",
)
PLACED = """SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY elapsed DESC,
    timestamp_ms, label, response_code, url) AS INTEGER) AS place FROM samples"""
check("t1_slowest", sampling.slowest, f"SELECT * FROM ({PLACED}) p WHERE place <= 20")
check(
    "f27_slowest_table",
    charts.slowest_table,
    f"""SELECT run_id, place, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M:%S')
    AS time, label, elapsed, response_code, CASE WHEN length(url) > 60
    THEN substr(url, 1, 60) || '…' ELSE url END AS url FROM ({PLACED}) p WHERE place <= 20""",
)
check(
    "f28_error_sunburst",
    charts.error_sunburst,
    """SELECT run_id, response_code AS id, response_code AS name, '' AS parent, count(*) AS value
    FROM samples WHERE NOT success GROUP BY run_id, response_code
    UNION ALL SELECT run_id, response_code || '|' || label, label, response_code, count(*)
    FROM samples WHERE NOT success GROUP BY run_id, response_code, label""",
    kind="stressed",
)
check(
    "f29_variability",
    charts.variability,
    """SELECT *, CASE WHEN cv > 2 THEN 'very high' WHEN cv > 1 THEN 'high' ELSE 'normal' END AS band
    FROM (SELECT *, CASE WHEN mean > 0 THEN coalesce(std / mean, 0.0) ELSE 0.0 END AS cv FROM
    (SELECT run_id, label, avg(elapsed) AS mean, stddev_samp(elapsed) AS std
    FROM samples GROUP BY run_id, label) v) c""",
    "mean std cv",
)
check(
    "t2_top_labels",
    lambda s: sampling.top_labels(s, 3),
    """SELECT run_id, label, rows FROM (SELECT run_id, label, count(*) AS rows,
    row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, label) AS place
    FROM samples GROUP BY run_id, label) p WHERE place <= 3""",
)


def _picked(s: DataFrame, picked: DataFrame, on: list[str]) -> DataFrame:
    """What must hold for any sample: its size, its total, and that its rows exist as often."""
    real = s.groupBy(*on).agg(F.count(F.lit(1)).alias("there"))
    taken = picked.groupBy(*on).agg(F.count(F.lit(1)).alias("taken"), F.max("total_rows").alias("total_rows"))
    return (
        taken.join(real, on, "left")
        .groupBy("run_id")
        .agg(
            F.sum("taken").alias("rows"),
            F.sum(F.least("taken", F.coalesce("there", F.lit(0)))).alias("real_rows"),
            F.max("total_rows").alias("total_rows"),
        )
    )


def _stratified(s: DataFrame) -> DataFrame:
    picked = sampling.stratified_sample(s, 100)
    return _picked(s, picked, ["run_id", "label", "timestamp_ms", "elapsed"])


def _uniform(s: DataFrame) -> DataFrame:
    picked = sampling.uniform_sample(s, 100)
    return _picked(s, picked, ["run_id", "timestamp_ms", "elapsed"])


def _charted(s: DataFrame, chart: DataFrame, on: list[str]) -> DataFrame:
    return _picked(s, chart.withColumn("timestamp_ms", F.unix_millis("ts")), on)


STRATIFIED = """WITH c AS (SELECT run_id, label, count(*) AS n FROM samples GROUP BY run_id, label),
    t AS (SELECT *, sum(n) OVER (PARTITION BY run_id) AS total FROM c),
    q AS (SELECT run_id, total, CASE WHEN total <= 100 THEN n ELSE
        least(n, greatest(1, round_even(100.0 * n / total, 0))) END AS quota FROM t)
    SELECT run_id, CAST(least(100, sum(quota)) AS BIGINT) AS rows,
    CAST(least(100, sum(quota)) AS BIGINT) AS real_rows, CAST(max(total) AS BIGINT) AS total_rows
    FROM q GROUP BY run_id"""
UNIFORM = """SELECT run_id, least(100, count(*)) AS rows, least(100, count(*)) AS real_rows,
    count(*) AS total_rows FROM samples GROUP BY run_id"""
BY_LABEL = ["run_id", "label", "timestamp_ms", "elapsed"]
check("t3_stratified_sample", _stratified, STRATIFIED)
check("t4_uniform_sample", _uniform, UNIFORM)
check("f1_rt_scatter_sampled", lambda s: _charted(s, charts.rt_scatter(s, 100), BY_LABEL), STRATIFIED)
check("f17_outliers_sampled", lambda s: _charted(s, charts.outlier_scatter(s, 100), BY_LABEL), STRATIFIED)
check(
    "f20_status_sampled",
    lambda s: _charted(s, charts.rt_by_status(s, 100), ["run_id", "timestamp_ms", "elapsed"]),
    UNIFORM,
)
# The chart samples are larger than the runs of the check data, so whole runs come back.
check(
    "f1_rt_scatter",
    charts.rt_scatter,
    """SELECT run_id, timestamp_ms AS ts, label, elapsed,
    count(*) OVER (PARTITION BY run_id) AS total_rows FROM samples""",
)
check(
    "f17_outlier_scatter",
    charts.outlier_scatter,
    f"""SELECT run_id, timestamp_ms AS ts, label, elapsed,
    count(*) OVER (PARTITION BY run_id) AS total_rows, is_outlier FROM ({OUTLIERS}) o""",
)
STATUS = """CASE WHEN success THEN 'Success' WHEN response_code LIKE '4%' THEN 'Client Error'
    ELSE 'Server Error' END"""
check(
    "f20_rt_by_status",
    charts.rt_by_status,
    f"""SELECT run_id, timestamp_ms AS ts, elapsed, {STATUS} AS status,
    count(*) OVER (PARTITION BY run_id) AS total_rows FROM samples""",
    kind="stressed",
)
check(
    "rollup_percentiles",
    lambda s: summary.percentiles(rollup(s)),
    PERCENTILE_SQL.format(label="label,", group=", label"),
    PERCENTILE_DOUBLES,
)

# ---- columns and cleaning ------------------------------------------------------------------

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
IS_NUMBER = f"regexp_full_match(trim(timestamp_ms), '{NUMBER}')"
WHOLE = "CAST(trunc(TRY_CAST(trim(timestamp_ms) AS DOUBLE)) AS BIGINT)"
MOMENT = "try_strptime(trim(timestamp_ms), ['%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d %H:%M:%S'])"
TS = f"""CASE WHEN {IS_NUMBER} THEN CASE WHEN {WHOLE} > 1000000000000 THEN {WHOLE}
    ELSE {WHOLE} * 1000 END ELSE epoch_ms({MOMENT}) END"""
ELAPSED = "CASE WHEN regexp_full_match(elapsed, '-?[0-9]+') THEN CAST(elapsed AS BIGINT) END"
BOOL = """CASE WHEN lower(trim(success)) IN ('true', '1', 'yes') THEN TRUE
    WHEN lower(trim(success)) IN ('false', '0', 'no') THEN FALSE END"""
check(
    "c1_normalize_timestamp",
    lambda s: s.select("event_id", P.normalize_timestamp("timestamp_ms").alias("timestamp_ms")),
    f"SELECT event_id, {TS} AS timestamp_ms FROM samples",
    kind="raw",
    texts="timestamp_ms",
)
check(
    "c2_timestamp_format",
    lambda s: s.groupBy("run_id", P.timestamp_format("timestamp_ms").alias("format")).agg(
        F.count(F.lit(1)).alias("rows")
    ),
    f"""SELECT run_id, CASE WHEN {IS_NUMBER} THEN CASE WHEN {WHOLE} > 1000000000000
    THEN 'epoch_ms' ELSE 'epoch_s' END WHEN {MOMENT} IS NOT NULL THEN 'datetime' END AS format,
    count(*) AS rows FROM samples GROUP BY run_id, format""",
    kind="raw",
)
check(
    "c3_normalize_bool",
    lambda s: s.select("event_id", P.normalize_bool("success").alias("success")),
    f"SELECT event_id, {BOOL} AS success FROM samples",
    kind="raw",
    texts="success",
)
check(
    "c4_normalize_int",
    lambda s: s.select("event_id", P.normalize_int("elapsed").alias("elapsed")),
    f"SELECT event_id, {ELAPSED} AS elapsed FROM samples",
    kind="raw",
    texts="elapsed",
)
NAMES = SAMPLES_SCHEMA.fieldNames()
INTS = ["bytes", "sent_bytes", "grp_threads", "all_threads", "latency", "idle_time", "connect"]


def _typed_sql(extra: str = "", text: str = "{c}") -> str:
    done = {"timestamp_ms": TS, "elapsed": ELAPSED, "success": BOOL}
    done |= {c: f"CAST({c} AS BIGINT)" for c in INTS}
    fields = [f"{done.get(c, text.format(c=c))} AS {c}" for c in NAMES]
    return f"SELECT event_id, run_id, {', '.join(fields)}{extra} FROM samples"


REASON = f"""concat_ws('; ', CASE WHEN ({ELAPSED}) IS NULL THEN 'elapsed is null'
    WHEN ({ELAPSED}) < 0 THEN 'elapsed is negative: ' || ({ELAPSED}) END,
    CASE WHEN timestamp_ms IS NULL THEN 'missing required field: timestamp_ms'
    WHEN ({TS}) IS NULL THEN 'unparseable timestamp: ''' || timestamp_ms || '''' END)"""
STRICT = """concat_ws('; ', CASE WHEN elapsed IS NULL THEN 'missing required field: elapsed'
    WHEN TRY_CAST(elapsed AS DOUBLE) IS NULL
    THEN 'elapsed is not numeric: ''' || elapsed || ''''
    WHEN CAST(elapsed AS DOUBLE) < 0 THEN 'elapsed is negative: ' || elapsed END,
    CASE WHEN timestamp_ms IS NULL THEN 'missing required field: timestamp_ms' END)"""
GOOD = f"SELECT * FROM ({_typed_sql()}) t WHERE elapsed >= 0 AND timestamp_ms IS NOT NULL"
JSON = f"to_json(struct_pack({', '.join(f'{c} := {c}' for c in NAMES)}))"


def _bad_sql(reason: str) -> str:
    return f"""SELECT * FROM (SELECT event_id, run_id, {reason} AS reason,
    CAST({JSON} AS VARCHAR) AS raw_json FROM samples) q WHERE reason <> ''"""


check("c5_clean_samples", lambda s: cleaning.clean(s)[0], GOOD, kind="raw", texts="success")
check("c5_quarantine", lambda s: cleaning.clean(s)[1].drop("row_index"), _bad_sql(REASON), kind="raw")
check(
    "c6_validate_rows",
    lambda s: cleaning.clean(s, "validate")[1].drop("row_index"),
    _bad_sql(STRICT),
    kind="raw",
)
check(
    "c7_time_bucket",
    lambda s: s.select("event_id", C.time_bucket("timestamp_ms", 30).alias("bucket")),
    f"SELECT event_id, {bucket(30)} FROM samples",
)
check(
    "c8_rt_band",
    lambda s: s.groupBy("run_id", C.rt_band("elapsed").alias("band")).agg(
        F.count(F.lit(1)).alias("rows")
    ),
    f"""SELECT run_id, {BAND_NAMES}[{BAND} + 1] AS band, count(*) AS rows FROM samples
    GROUP BY run_id, band""",
)
check(
    "c9_status_group",
    lambda s: s.select("event_id", C.status_group().alias("status")),
    f"SELECT event_id, {STATUS} AS status FROM samples",
    kind="stressed",
)
check(
    "c10_transfer_time",
    lambda s: s.select("event_id", C.transfer_time().alias("transfer")),
    f"SELECT event_id, CAST({TRANSFER} AS BIGINT) AS transfer FROM samples",
)
check(
    "c12_variability_band",
    lambda s: s.select("event_id", C.variability_band(F.col("elapsed") / 500.0).alias("band")),
    """SELECT event_id, CASE WHEN elapsed / 500.0 > 2 THEN 'very high' WHEN elapsed / 500.0 > 1
    THEN 'high' ELSE 'normal' END AS band FROM samples""",
)
check(
    "c13_text",
    lambda s: s.select(
        "event_id",
        C.time_text("timestamp_ms").alias("time"),
        C.short_url(F.concat("url", F.repeat(F.lit("/x"), (F.col("event_id") % 40).cast("int")))).alias(
            "url"
        ),
    ),
    """SELECT event_id, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%d %H:%M:%S') AS time,
    CASE WHEN length(u) > 60 THEN substr(u, 1, 60) || '…' ELSE u END AS url FROM
    (SELECT *, url || repeat('/x', event_id % 40) AS u FROM samples) s""",
)

# ---- sources, sinks and streaming: files that Spark writes from the events -----------------

AS_READ = "SELECT run_id, " + ", ".join(f"nullif({c}, '') AS {c}" for c in NAMES) + " FROM samples"


def _mapped(s: DataFrame) -> DataFrame:
    """Source names in odd case and order, with a column nobody knows."""
    renamed = [F.col(c).alias(inputs.CSV_NAMES[c].upper()) for c in reversed(NAMES)]
    return map_columns(s.select("event_id", *renamed))


def _read_csv(s: DataFrame) -> DataFrame:
    raw = ingest.read_raw(s.sparkSession, [f"{inputs.write_csv_files(s)}/*"])
    return raw.select(inputs.run_of_folder("source_file").alias("run_id"), *NAMES)


def _read_xml(s: DataFrame) -> DataFrame:
    raw = ingest.read_raw(s.sparkSession, [f"{inputs.write_xml_files(s)}/*"])
    return raw.drop("source_file")


def _classified(s: DataFrame) -> DataFrame:
    spark = s.sparkSession
    folders = [f"{inputs.write_csv_files(s)}/*", f"{inputs.write_xml_files(s)}/*"]
    kinds = classify_inputs(spark, folders)
    return kinds.select(
        inputs.run_of_folder("path").alias("run_id"), "format", "delimiter"
    ).distinct()


def _ingested(s: DataFrame) -> ingest.Ingested:
    spark = s.sparkSession
    run = inputs.run_of_folder(F.col("source_file"))
    folder = inputs.write_csv_files(s)
    return ingest.ingest(spark, [f"{folder}/*"], inputs.fresh_folder(spark, "tables"), run)


def _sunk(s: DataFrame) -> DataFrame:
    path = inputs.fresh_folder(s.sparkSession, "samples")
    tables.write_samples(cleaning.clean(s)[0], path)
    return tables.read_samples(s.sparkSession, path)


def _quarantined(s: DataFrame) -> DataFrame:
    path = inputs.fresh_folder(s.sparkSession, "quarantine")
    tables.write_quarantine(cleaning.clean(s)[1], path)
    return tables.read_quarantine(s.sparkSession, path).drop("row_index")


def _streams(s: DataFrame, merge_every: int = live.MERGE_EVERY) -> list[str]:
    """All runs as streams, one per header, a file at a time; they share nothing and run side by side."""
    spark, folder, outs, started = s.sparkSession, inputs.write_csv_files(s), [], []
    try:
        for run, (columns, delimiter) in reversed(inputs.CSV_LAYOUTS.items()):
            header = delimiter.join(["dataType", *[inputs.CSV_NAMES[c] for c in columns]])
            raw = live.stream_jtl_csv(
                spark, f"{folder}/{run}", header, delimiter, inputs.run_of_folder(F.col("source_file")), files_per_trigger=1
            )
            outs.append(inputs.fresh_folder(spark, "live"))
            started.append(live.write_live(raw, outs[-1], inputs.fresh_folder(spark, "state"), merge_every=merge_every))
        for stream in started:
            stream.awaitTermination()
    finally:
        for stream in started:
            stream.stop()  # the others, if one fails
    return outs


def _streamed(s: DataFrame) -> DataFrame:
    counts = [live.read_live(s.sparkSession, out) for out in _streams(s)]
    return live.bucket_metrics(reduce(DataFrame.unionByName, counts))


def _merged_labels(s: DataFrame) -> DataFrame:
    found = [live.live_samples(s.sparkSession, out) for out in _streams(s, merge_every=2)]
    return summary.label_summary(reduce(DataFrame.unionByName, found))


def _streamed_quarantine(s: DataFrame) -> DataFrame:
    found = [live.live_quarantine(s.sparkSession, out) for out in _streams(s)]
    return reduce(DataFrame.unionByName, found).select("run_id", "reason")


def _read_deep_xml(s: DataFrame) -> DataFrame:
    return read_jtl_xml(s.sparkSession, inputs.write_deep_xml(s)).select(*NAMES, "unread_xml")


check("i2_csv_scan", _read_csv, AS_READ, kind="raw")
check(
    "i2_csv_line_breaks",
    lambda s: _read_csv(
        s.withColumn(
            "failure_message",
            F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('first "line",\n\n"second" '), F.col("event_id").cast("string")))
            .otherwise(F.col("failure_message")),
        )
    ),
    AS_READ.replace("nullif(failure_message, '')", """CASE WHEN event_id % 7 = 0 THEN 'first "line",' || chr(10) || chr(10)
    || '"second" ' || CAST(event_id AS VARCHAR) ELSE nullif(failure_message, '') END"""),
    kind="raw",
)
check(
    "i2_csv_many_headers",
    lambda s: ingest.read_raw(s.sparkSession, [f"{inputs.write_varied_csv(s)}/*"]).select(*NAMES),
    AS_READ.replace("SELECT run_id, ", "SELECT "),
    kind="raw",
)
check(
    "i3_map_columns",
    _mapped,
    "SELECT " + ", ".join(NAMES) + " FROM samples",
    kind="raw",
)
check(
    "i4_xml_scan",
    lambda s: _read_xml(s).select(*NAMES, "unread_xml"),
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in NAMES)
    + ", CAST(NULL AS VARCHAR) AS unread_xml FROM samples",
    kind="raw",
)
check(
    "i4_xml_deep",
    _read_deep_xml,
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in NAMES)
    + ", CAST(NULL AS VARCHAR) AS unread_xml FROM samples",
    kind="raw",
)
XML_AS_READ = "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in NAMES) + ", CAST(NULL AS VARCHAR) AS unread_xml FROM samples"
check(
    "i4_xml_cdata",
    lambda s: read_jtl_xml(s.sparkSession, inputs.write_cdata_xml(s)).select(*NAMES, "unread_xml"),
    XML_AS_READ.replace(
        "nullif(failure_message, '')",
        """CASE WHEN event_id % 5 = 0 THEN 'at ' || CAST(event_id AS VARCHAR) || '> <sample t="1" lb="ghost"/> <!-- ]] &lt; </failureMessage>'
        ELSE nullif(failure_message, '') END""",
    ),
    kind="raw",
)
check(
    "i4_xml_comments",
    lambda s: read_jtl_xml(s.sparkSession, inputs.write_commented_xml(s)).select(*NAMES, "unread_xml"),
    XML_AS_READ + " WHERE event_id % 11 <> 0",
    kind="raw",
)
check(
    "i1_classify_inputs",
    _classified,
    """SELECT DISTINCT run_id, 'csv' AS format, CASE run_id WHEN 'run-a' THEN ',' WHEN 'run-b'
    THEN ';' ELSE chr(9) END AS delimiter FROM samples
    UNION ALL SELECT DISTINCT 'run-x', 'xml', NULL FROM samples""",
    kind="raw",
)
check(
    "i6_samples_sink",
    _sunk,
    f"SELECT * EXCLUDE (event_id) FROM ({GOOD}) g",
    kind="raw",
    texts="success",
)
check(
    "i7_quarantine_sink",
    _quarantined,
    f"SELECT run_id, reason, raw_json FROM ({_bad_sql(REASON)}) b",
    kind="raw",
)
check(
    "i8_ingested_samples",
    lambda s: _ingested(s).samples,
    f"""SELECT * EXCLUDE (event_id) REPLACE (nullif(failure_message, '') AS failure_message)
    FROM ({GOOD}) g""",
    kind="raw",
    texts="success",
)
check(
    "i9_ingest_counts",
    lambda s: _ingested(s).counts,
    f"""SELECT run_id, count(*) - bad AS parsed_rows, bad AS error_rows, count(*) AS total_rows
    FROM (SELECT s.run_id, coalesce(n, 0) AS bad FROM samples s LEFT JOIN
    (SELECT run_id, count(*) AS n FROM ({_bad_sql(REASON)}) b GROUP BY run_id) c
    ON s.run_id = c.run_id) t GROUP BY run_id, bad""",
    kind="raw",
)
check(
    "i10_ingest_summary",
    lambda s: _ingested(s).summary,
    LABEL_AGGREGATE.format(source=f"({GOOD}) g"),
    "mean_elapsed p50 p90 p95 p99 error_rate",
    "raw",
)
check(
    "s1_live_bucket_metrics",
    _streamed,
    f"""SELECT run_id, {bucket(10)}, {ERRORS} AS error_count, count(*) AS total_count,
    {ERRORS} * 1.0 / count(*) AS error_rate, {quantiles(0.5, 0.9, 0.95, 0.99)}
    FROM ({GOOD}) g GROUP BY run_id, bucket""",
    "error_rate p50 p90 p95 p99",
    "raw",
)
check(
    "s1_merged_batches",
    _merged_labels,
    LABEL_SUMMARY.replace("FROM samples", f"FROM ({GOOD}) g"),
    LABEL_SUMMARY_DOUBLES,
    "raw",
)
check(
    "s1_live_quarantine",
    _streamed_quarantine,
    f"SELECT run_id, reason FROM ({_bad_sql(REASON)}) b",
    kind="raw",
)
