import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgauge.operators import slo, summary
from loadgauge.model import SloConfig


def test_percentiles_equal_numpy(make):
    values = [(i * 7919) % 1009 for i in range(257)]
    row = summary.percentiles(make(values, label=["x"] * 257)).first()
    for p in summary.PERCENTILES:
        got = row[summary.percentile_name(p)]
        assert got == pytest.approx(np.percentile(values, p * 100), abs=1e-9)
    assert (row["count"], row["min"], row["max"]) == (257, min(values), max(values))
    assert row["mean"] == pytest.approx(np.mean(values))
    assert row["std"] == pytest.approx(np.std(values, ddof=1))


def test_single_row_has_no_std_and_flat_percentiles(make):
    row = summary.percentiles(make([42])).first()
    assert row["std"] is None and row["p50"] == row["p999"] == 42.0


def test_std_survives_a_large_offset(make):
    values = [10**9 + i % 2 for i in range(1000)]
    row = summary.percentiles(make(values), by_label=False).first()
    assert row["std"] == pytest.approx(np.std([i % 2 for i in range(1000)], ddof=1), rel=1e-9)


def test_missing_elapsed_counts_but_has_no_percentile(make):
    row = summary.percentiles(make([10, None, 20, None]), by_label=False).first()
    assert (row["count"], row["p50"], row["mean"]) == (4, 15.0, 15.0)
    alone = summary.percentiles(make([None, None]), by_label=False).first()
    assert alone["count"] == 2 and alone["p50"] is None and alone["mean"] is None


def test_percentile_names_must_differ(make):
    with pytest.raises(ValueError):
        summary.percentiles(make([1]), ps=[0.99, 0.9949])


def test_percentiles_are_ordered(failing):
    for row in summary.percentiles(failing).collect():
        names = [summary.percentile_name(p) for p in summary.PERCENTILES]
        assert [row[n] for n in names] == sorted(row[n] for n in names)


def test_empty_input_gives_empty_output(fast):
    none = fast.filter("false")
    for operator in (summary.percentiles, summary.label_aggregate, summary.label_summary):
        assert operator(none).collect() == []
    assert summary.label_aggregate(none).columns[1:] == [
        "label", "count", "mean_elapsed", "p50", "p90", "p95", "p99",
        "error_rate", "min_elapsed", "max_elapsed",
    ]


def test_unknown_success_is_no_error(make):
    samples = make([1, 1, 1, 1], success=[True, False, None, None], label=["a"] * 4)
    row = summary.label_summary(samples).first()
    assert (row["error_count"], row["error_rate"]) == (1, 0.25)


def test_null_label_is_a_group_of_its_own(make):
    rows = summary.label_summary(make([1, 2, 3], label=[None, "a", None])).collect()
    assert {r["label"]: r["count"] for r in rows} == {None: 2, "a": 1}


def test_apdex_bounds_are_inclusive(make):
    row = summary.apdex(make([500, 501, 2000, 2001], label=["a"] * 4)).first()
    assert (row["satisfied"], row["tolerating"], row["frustrated"]) == (1, 2, 1)
    assert row["apdex_score"] == 0.5 and row["total"] == 4


def test_apdex_of_fast_and_slow(fast, slow):
    assert all(r["apdex_score"] >= 0.99 for r in summary.apdex(fast, t=1.0).collect())
    assert all(r["apdex_score"] <= 0.01 for r in summary.apdex(slow, t=0.1).collect())


def test_correlations_of_constant_columns_are_zero(fast):
    cells = {(r["col_a"], r["col_b"]): r["correlation"] for r in summary.correlations(fast).collect()}
    assert len(cells) == 36
    assert cells["elapsed", "elapsed"] == 1.0
    assert cells["bytes", "bytes"] == 0.0 and cells["bytes", "elapsed"] == 0.0
    assert cells["elapsed", "latency"] == pytest.approx(1.0)
    assert all(cells[a, b] == cells[b, a] for a, b in cells)


def test_correlations_use_rows_that_have_both(make):
    rng = np.random.default_rng(5)
    elapsed = [int(v) for v in rng.integers(1, 900, 300)]
    size = [None if i % 3 == 0 else int(v) for i, v in enumerate(rng.integers(1, 900, 300))]
    threads = [None if i % 5 == 0 else elapsed[i] // 3 + i for i in range(300)]
    samples = make(elapsed, bytes=size, all_threads=threads)
    cells = {(r["col_a"], r["col_b"]): r["correlation"] for r in summary.correlations(samples).collect()}
    for name, values in (("bytes", size), ("all_threads", threads)):
        both = [(e, v) for e, v in zip(elapsed, values) if v is not None]
        assert cells["elapsed", name] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])
    both = [(a, b) for a, b in zip(size, threads) if a is not None and b is not None]
    assert cells["bytes", "all_threads"] == pytest.approx(np.corrcoef(np.array(both).T)[0, 1])


def test_gauges_weigh_labels_by_their_samples(failing):
    scores = summary.apdex(failing)
    weighted = scores.agg((F.sum(F.expr("apdex_score * total")) / F.sum("total")).alias("w")).first()
    row = slo.overall_gauges(failing).first()
    assert row["apdex_score"] == pytest.approx(weighted["w"])
    assert row["error_rate_pct"] == pytest.approx(20.0)
    assert (row["error_rate_ok"], row["p99_ok"]) == (False, True)


def test_kpis(fast, slow):
    row = slo.run_kpis(fast).first()
    assert row["slo_status"] == "PASS" and row["samples"] == 200
    assert slo.run_kpis(slow).first()["slo_status"] == "FAIL"


def test_slo_thresholds_are_inclusive(make):
    samples = make([1000] * 20, label=["a"] * 20)
    exact = slo.slo_compliance(samples, SloConfig(1000.0, 1000.0, 0.0)).first()
    assert exact["overall_compliant"]
    below = slo.slo_compliance(samples, SloConfig(999.9, 1000.0, 0.0)).first()
    assert not below["p90_compliant"] and not below["overall_compliant"]


def test_keys_are_needed(fast):
    with pytest.raises(ValueError):
        summary.percentiles(fast, keys=())
