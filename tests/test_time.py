"""Series, segments, anomalies and findings."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadgauge.operators import anomalies, findings, segments, series
from tests.conftest import BASE_TS


def test_throughput_total_and_labels(bursts):
    rows = series.throughput(bursts, 10).collect()
    totals = sorted(r["rps"] for r in rows if r["is_total"])
    assert totals == [0.5, 5.0, 8.0]
    assert sum(r["rps"] for r in rows if not r["is_total"]) == pytest.approx(13.5)


def test_label_called_all_is_not_the_total(make):
    rows = series.throughput(make([1, 1], label=["ALL", "b"], ts=[0, 1])).collect()
    assert {(r["label"], r["is_total"]): r["rps"] for r in rows} == {
        ("ALL", True): 0.4,
        ("ALL", False): 0.2,
        ("b", False): 0.2,
    }


def test_buckets_start_on_the_clock(make):
    row = series.threads(make([1], ts=[BASE_TS + 7_300])).first()
    assert row["bucket"].replace(tzinfo=dt.UTC).timestamp() == (BASE_TS + 5_000) / 1000


def test_most_frequent_failing_code_smallest_on_ties(make):
    samples = make(
        [1] * 5,
        success=[False, False, False, False, True],
        ts=[0, 1, 2, 3, 4],
        response_code=["503", "500", "500", "503", "200"],
    )
    row = series.errors(samples).first()
    assert (row["error_count"], row["total_count"], row["response_code"]) == (4, 5, "500")


def test_efficiency_of_no_time_or_no_bytes_is_zero(make):
    assert series.throughput_efficiency(make([0, 0], ts=[0, 1])).first()["bytes_per_ms"] == 0.0
    none = make([5], ts=[0], bytes=[None], sent_bytes=[None])
    assert series.throughput_efficiency(none).first()["bytes_per_ms"] == 0.0


def test_transfer_time_is_zero_when_a_part_is_unknown(make):
    samples = make([100, 100], ts=[0, 1], latency=[30, None])
    assert series.latency_components(samples).first()["transfer_mean"] == pytest.approx(30.0)


def test_spike_needs_a_threshold_within_reach(spike):
    found = anomalies.rt_spikes(spike, z=2.5).filter("is_anomaly").collect()
    assert len(found) == 1 and found[0]["z_score"] == pytest.approx(9 / 10**0.5)
    assert anomalies.rt_spikes(spike, z=3.0).filter("is_anomaly").count() == 0


def test_no_spike_without_spread_or_second_bucket(make):
    assert {r["z_score"] for r in anomalies.rt_spikes(make([5] * 40)).collect()} == {0.0}
    assert anomalies.rt_spikes(make([5, 6], ts=[0, 1])).first()["is_anomaly"] is False


def test_error_spike_against_the_mean_rate(make):
    success = [not 50 <= i < 55 for i in range(200)]
    found = anomalies.error_spikes(make([1] * 200, success=success)).collect()
    assert [r["error_rate"] for r in found] == [0.5]


def knee_by_hand(rows):
    rows = sorted(rows)
    if len(rows) < 3:
        return None
    p90 = [r[2] for r in rows]
    n = max(1, len(rows) // 4)
    steps = [b - a for a, b in zip(p90, p90[1:])]
    slope, quiet = max(sum(steps[:n]) / n, 0.1), sum(p90[:n]) / n
    for i, step in enumerate(steps):
        if step > 2 * slope and p90[i + 1] > 2 * quiet:
            return rows[i + 1][0], p90[i + 1]
    return None


@pytest.mark.parametrize("spans", [2, 3, 9, 16])
def test_knee_equals_a_plain_loop(make, spans):
    ts, elapsed = [], []
    for span in range(spans):
        size = 3 + span * 2
        for i in range(size):
            ts.append(BASE_TS + 10_000 * span + i)
            elapsed.append(100 + 3 * span + (900 if span > spans * 2 // 3 else 0) + i)
    samples = make(elapsed, ts=ts)
    rows = [(r["rps"], r["bucket"], r["p90"]) for r in anomalies.rate_vs_p90(samples).collect()]
    want = knee_by_hand(rows)
    got = anomalies.knee(samples).first()
    assert (None if got is None else (got["knee_rps"], got["knee_p90_ms"])) == want


def test_knee_orders_equal_rates_by_time(spark):
    rows = [("r", 1.0, i, p) for i, p in enumerate([100.0, 101.0, 102.0, 500.0, 103.0])]
    buckets = spark.createDataFrame(rows, "run_id string, rps double, bucket long, p90 double")
    assert anomalies.knee_of(buckets).first()["knee_p90_ms"] == 500.0


def test_warmup_ends_with_the_first_busy_bucket(make):
    ts = [BASE_TS + 100 + 5000 * i for i in range(4)]
    ts += [BASE_TS + 20_000 + 50 * i for i in range(400)]
    row = segments.warmup(make([10] * len(ts), ts=ts)).first()
    assert row["start_ms"] == BASE_TS + 100
    assert row["warmup_end_ms"] == BASE_TS + 20_000
    assert row["test_end_ms"] == max(ts) + 10


def test_warmup_ends_halfway_at_the_latest(make):
    ts = [BASE_TS + 5000 * i for i in range(20)] + [BASE_TS + 100_000 + i for i in range(50)]
    row = segments.warmup(make([100] * len(ts), ts=ts)).first()
    assert row["warmup_end_ms"] == (row["start_ms"] + row["test_end_ms"]) // 2


def test_warmup_may_end_before_the_first_sample(make):
    row = segments.warmup(make([1, 1], ts=[BASE_TS + 3000, BASE_TS + 3001])).first()
    assert row["warmup_end_ms"] <= row["start_ms"]


def test_empty_phase_has_zero_percentiles(make):
    samples = make([10] * 50, ts=[BASE_TS + i for i in range(50)])
    rows = {r["phase"]: r["p90"] for r in segments.steady_compare(samples).collect()}
    assert rows == {"Warmup": 0.0, "Steady": 10.0}


def test_steady_samples_lie_within_bounds(failing):
    bounds = segments.warmup(failing).first()
    times = [r["timestamp_ms"] for r in segments.steady(failing).collect()]
    assert min(times) >= bounds["warmup_end_ms"] and len(times) == 200


def test_trend_needs_spread(bursts, fast):
    line = anomalies.linear_trend(bursts).orderBy("point").collect()
    assert len(line) == 100 and (line[0]["rps"], line[-1]["rps"]) == (0.5, 8.0)
    assert anomalies.linear_trend(fast).count() == 0


def test_nearest_fences_include_the_fence_itself(make):
    values = [10, 20, 30, 40, 50, 60, 70, 80, 1000]
    judged = anomalies.iqr_outliers(make(values, label=[None] * 9))
    assert [r["elapsed"] for r in judged.filter("is_outlier").collect()] == [1000]
    fences = anomalies.iqr_fences(make(values, label=["a"] * 9)).first()
    assert (fences["low_fence"], fences["high_fence"]) == (-30.0, 130.0)


def kinds(df):
    return {(r["kind"], r["severity"]) for r in df.collect()}


def test_findings_of_the_fixtures(fast, slow, failing, tail):
    assert not any(severity == "critical" for _, severity in kinds(findings.findings(fast)))
    assert ("slo_violation", "critical") in kinds(findings.findings(slow))
    found = kinds(findings.findings(failing))
    assert {("error_spike", "critical"), ("slo_violation", "critical")} <= found
    assert ("tail_latency_ratio", "critical") in kinds(findings.findings(tail))
    assert ("warmup_window", "info") in kinds(findings.findings(fast))


def test_findings_come_most_severe_first(failing, tail):
    for samples in (failing, tail):
        order = [findings.SEVERITIES.index(r["severity"]) for r in findings.findings(samples).collect()]
        assert order == sorted(order)


def test_cold_start(make):
    success = [i >= 20 for i in range(300)]
    row = findings.cold_start(make([1] * 300, success=success)).first()
    assert row["data"]["first_30s_error_rate"] == pytest.approx(20 / 30)
    assert row["data"]["overall_error_rate"] == pytest.approx(20 / 300)
    assert row["message"] == "Errors cluster at the start: 66.7% in the first 30 s, 6.7% overall"


def test_zero_median_counts_as_one(make):
    row = findings.tail_latency(make([0] * 99 + [5000] * 11, label=["a"] * 110)).first()
    assert row["data"]["p50"] == 1.0 and row["severity"] == "critical"


def test_two_runs_are_the_union_of_each_alone(make, failing):
    other = failing.withColumns(
        {
            "run_id": F.lit("run-2"),
            "timestamp_ms": F.col("timestamp_ms") + 3_600_000,
            "elapsed": F.col("elapsed") * 7,
        }
    )
    both = failing.unionByName(other)
    for operator in (
        series.throughput, series.errors, anomalies.rt_spikes, anomalies.error_spikes,
        anomalies.knee, segments.warmup, segments.steady_compare, findings.findings,
        anomalies.linear_trend,
    ):
        alone = operator(failing).collect() + operator(other).collect()
        assert sorted(map(str, operator(both).collect())) == sorted(map(str, alone))
