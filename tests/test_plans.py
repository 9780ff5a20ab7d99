"""What the plans promise: pruning, no cross joins, and results without broadcasts."""

import re

import pytest
from pyspark.sql import functions as F

from loadgauge.operators import anomalies, charts, findings, sampling, segments, series, slo, summary
from loadgauge.plans.histogram import rollup
from loadgauge.sources import tables


@pytest.fixture(scope="module")
def stored(spark, make, tmp_path_factory):
    """Two runs, one of them and one label with most rows; a label is missing."""
    n = 900
    samples = make(
        [(i * 37) % 700 if i % 3 else 500 for i in range(n)],
        success=[None if i % 19 == 0 else i % 6 != 0 for i in range(n)],
        label=["hot" if i % 2 else (None if i % 10 == 0 else f"L{i % 4}") for i in range(n)],
    ).withColumn("run_id", F.expr("if(timestamp_ms % 9000 = 0, 'small', 'large')"))
    path = f"{tmp_path_factory.mktemp('stored')}/samples"
    tables.write_samples(samples, path)
    return tables.read_samples(spark, path)


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


OPERATORS = {
    "label_summary": summary.label_summary,
    "percentiles": summary.percentiles,
    "correlations": summary.correlations,
    "throughput": series.throughput,
    "errors": series.errors,
    "rt_series": series.rt_series,
    "rt_spikes": anomalies.rt_spikes,
    "knee": anomalies.knee,
    "iqr_outliers": anomalies.iqr_outliers,
    "steady": segments.steady,
    "slo_compliance": slo.slo_compliance,
    "run_kpis": slo.run_kpis,
    "findings": findings.findings,
    "stratified": lambda s: sampling.stratified_sample(s, 50),
    "uniform": lambda s: sampling.uniform_sample(s, 50),
    "slowest": sampling.slowest,
    **{name: (lambda s, name=name: charts.chart(name, s)) for name in charts.CHARTS},
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_cross_join_no_global_window(stored, name):
    text = plan(OPERATORS[name](stored))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A window without partition columns shows an empty second list.
    assert not re.search(r"Arguments: \[.*windowspecdefinition.*\], \[\], \[", text)
    assert "PythonUDF" not in text and "BatchEvalPython" not in text


def test_scan_reads_only_what_it_needs(stored):
    text = plan(summary.apdex(stored))
    assert "ReadSchema: struct<elapsed:bigint,label:string>" in text
    text = plan(series.total_throughput(stored))
    assert "ReadSchema: struct<timestamp_ms:bigint>" in text


def test_filters_reach_the_scan(stored):
    text = plan(charts.rt_histogram(stored.filter("run_id = 'small'"), label="hot"))
    assert "EqualTo(label,hot)" in text and "PartitionFilters" in text


def test_percentiles_combine_before_the_shuffle_and_spread_hot_labels(stored):
    text = plan(summary.percentiles(stored))
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    spread = [re.sub(r"#\d+L?", "", e) for e in exchanges]
    assert any(e.startswith("run_id, label, elapsed") for e in spread)
    assert len(set(spread)) == 2


@pytest.mark.parametrize(
    "name",
    ["iqr_outliers", "steady", "slo_compliance", "run_kpis", "findings", "stratified", "uniform",
     "slowest", "fig-transaction-mix", "fig-steady-compare", "fig-outlier-scatter"],
)
def test_same_rows_when_facts_are_too_large_to_broadcast(spark, stored, name):
    want = sorted(map(str, OPERATORS[name](stored).collect()))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        df = OPERATORS[name](stored)
        assert "BroadcastHashJoin" not in plan(df)
        assert sorted(map(str, df.collect())) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_null_labels_keep_their_rows(stored):
    assert anomalies.iqr_outliers(stored).count() == 900
    mix = charts.transaction_mix(stored).groupBy("run_id", "bucket").agg(F.sum("share_pct").alias("s"))
    assert mix.filter("abs(s - 100) > 1e-9").count() == 0


def test_slowest_with_ties_and_unknown_times(make):
    samples = make([5, None, 9, 9, 9, 1, None])
    rows = sampling.slowest(samples, 4).orderBy("place").collect()
    assert [(r["elapsed"], r["timestamp_ms"] % 100_000) for r in rows] == [
        (9, 2000), (9, 3000), (9, 4000), (5, 0),
    ]
    rows = sampling.slowest(samples, 6).orderBy("place").collect()
    assert [r["elapsed"] for r in rows] == [9, 9, 9, 5, 1, None]
    assert sampling.slowest(samples, 2).count() == 2


@pytest.mark.parametrize(
    "operator",
    [segments.warmup, segments.steady, summary.label_summary, summary.correlations,
     charts.variability, charts.threads_error_grid, sampling.slowest, sampling.uniform_sample,
     series.throughput_efficiency, series.connect_breakdown],
)
def test_a_rollup_is_refused_where_samples_are_needed(stored, operator):
    with pytest.raises(ValueError, match="needs samples"):
        operator(rollup(stored))
