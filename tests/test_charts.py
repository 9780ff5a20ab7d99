import numpy as np
import pytest
from pyspark.sql import functions as F

from loadgauge.operators import charts, sampling, series, summary
from loadgauge.plans.histogram import rollup
from loadgauge.plans.joining import settle


def test_all_29_charts_have_rows(failing):
    assert len(charts.CHARTS) == 29
    for name in charts.CHARTS:
        if name != "fig-rt-throughput":
            assert charts.chart(name, failing).count() > 0, name


def test_empty_input_gives_no_rows(failing):
    none = failing.filter("false")
    for name in charts.CHARTS:
        assert charts.chart(name, none).count() == 0, name


def test_shares_sum_to_100_and_grid_is_filled(make):
    samples = make([1] * 30, label=["a"] * 10 + ["b"] * 10 + [None] * 10)
    rows = charts.transaction_mix(samples).collect()
    assert len(rows) == 9 and sum(r["share_pct"] for r in rows) == pytest.approx(300.0)


def test_histogram_holds_every_sample(make):
    values = [int(v) for v in np.random.default_rng(1).integers(0, 5000, 500)]
    rows = charts.rt_histogram(make(values)).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=50)
    assert [r["rows"] for r in rows] == counts.tolist()
    assert [r["low"] for r in rows] == pytest.approx(edges[:-1].tolist())


def test_histogram_of_equal_samples(make):
    rows = charts.rt_histogram(make([7] * 5)).collect()
    assert sorted(r["rows"] for r in rows) == [0] * 49 + [5]


@pytest.mark.parametrize("size", [1, 10, 57])
def test_cdf_equals_a_sort(make, size):
    values = [(i * 31) % 23 for i in range(size)]
    rows = charts.rt_cdf(make(values), points=10).orderBy("point").collect()
    kept = sorted(values)[:: max(1, size // 10)]
    assert [r["elapsed"] for r in rows] == kept
    assert [r["cdf_pct"] for r in rows] == pytest.approx(
        [(i + 1) / len(kept) * 100 for i in range(len(kept))]
    )


def test_heatmap_shows_bands_that_occur(make):
    rows = charts.rt_heatmap(make([50, 99, 100, 7000], ts=[0, 1, 2, 40_000])).collect()
    cells = {(r["bucket"].timestamp(), r["band"]): r["rows"] for r in rows}
    assert len(cells) == 6 and {r["band"] for r in rows} == {"0-100", "100-250", "5k+"}
    assert sorted(cells.values()) == [0, 0, 0, 1, 1, 2]


def test_grid_equals_numpy(make):
    rng = np.random.default_rng(3)
    threads = np.repeat(rng.integers(1, 40, 30), 10)
    success = [bool(v) for v in rng.random(300) > 0.1]
    samples = make([1] * 300, success=success, all_threads=[int(t) for t in threads])
    rows = charts.threads_error_grid(samples).collect()
    means = threads.reshape(30, 10).mean(axis=1)
    rates = (1 - np.array(success).reshape(30, 10).mean(axis=1)) * 100
    bins = min(8, max(3, len(np.unique(means))))
    edges = np.linspace(means.min(), means.max(), bins + 1)
    want, _, _ = np.histogram2d(means, np.round(rates, 9), bins=[edges, charts.ERROR_EDGES])
    got = np.zeros_like(want)
    for r in rows:
        got[r["thread_bin"], r["error_order"]] = r["buckets"]
    assert len(rows) == bins * 5 and (got == want).all()


def test_equal_threads_fall_in_the_last_bin(failing):
    rows = charts.threads_error_grid(failing).filter("buckets > 0").collect()
    assert {r["thread_bin"] for r in rows} == {2}


def test_sunburst_leaves_sum_to_their_ring(make):
    samples = make(
        [1] * 5,
        success=[False] * 4 + [True],
        label=["a", "a", "b", None, "a"],
        response_code=["500", "500", "500", None, "200"],
    )
    rows = {r["id"]: (r["parent"], r["value"]) for r in charts.error_sunburst(samples).collect()}
    assert rows == {
        "500": ("", 3),
        "None": ("", 1),
        "500|a": ("500", 2),
        "500|b": ("500", 1),
        "None|None": ("None", 1),
    }


def test_variability_of_single_row_is_zero(make):
    row = charts.variability(make([5], label=["a"])).first()
    assert (row["cv"], row["band"], row["std"]) == (0.0, "normal", None)


def test_slowest_table_prints(make):
    row = charts.slowest_table(make([9, 8], url=["u" * 61, None]), n=2).orderBy("place").collect()
    assert row[0]["url"] == "u" * 60 + "…" and row[1]["url"] == "None"
    assert row[0]["time"] == "2023-11-14 22:13:20"


def test_store_charts_and_rollup_agree(make, tmp_path):
    n = 400
    samples = make(
        [(i * 37) % 900 for i in range(n)],
        success=[None if i % 11 == 0 else i % 7 != 0 for i in range(n)],
        label=[None if i % 13 == 0 else "L" + str(i % 3) for i in range(n)],
    )
    rolled = settle(rollup(samples))
    for name in charts.CHARTS:
        charts.chart(name, samples).write.parquet(f"{tmp_path}/plain/{name}")
    charts.store_charts(samples, f"{tmp_path}/rolled", rolled=rolled)
    read = samples.sparkSession.read.parquet
    for name in charts.CHARTS:
        plain, other = read(f"{tmp_path}/plain/{name}"), read(f"{tmp_path}/rolled/{name}")
        assert plain.exceptAll(other).count() == 0 and other.exceptAll(plain).count() == 0, name


# ---- sampling ----------------------------------------------------------------------------


def quotas(counts, limit):
    total = sum(counts.values())
    if total <= limit:
        return counts
    return {k: min(n, max(1, round(limit * n / total))) for k, n in counts.items()}


@pytest.mark.parametrize("limit", [10, 25, 1000])
def test_stratified_sizes(make, limit):
    sizes = {"a": 100, "b": 48, "c": 1, None: 11}
    labels = [k for k, n in sizes.items() for _ in range(n)]
    samples = make(list(range(len(labels))), label=labels)
    picked = sampling.stratified_sample(samples, limit).collect()
    got = {}
    for r in picked:
        got[r["label"]] = got.get(r["label"], 0) + 1
    want = quotas(sizes, limit)
    assert len(picked) == min(limit, sum(want.values()))
    assert all(got.get(k, 0) <= n for k, n in want.items())
    if sum(want.values()) <= limit:
        assert got == want
    assert {r["total_rows"] for r in picked} == {160}
    real = {(r["label"], r["timestamp_ms"], r["elapsed"]) for r in samples.collect()}
    assert len({(r["label"], r["timestamp_ms"], r["elapsed"]) for r in picked}) == len(picked)
    assert all((r["label"], r["timestamp_ms"], r["elapsed"]) in real for r in picked)


def test_samples_of_copies_keep_their_size(make):
    samples = make([5] * 300, ts=[0] * 300, label=["a"] * 200 + ["b"] * 100)
    rows = sampling.stratified_sample(samples, 30).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in rows} == {"a": 20, "b": 10}
    assert sampling.uniform_sample(samples, 77).count() == 77
    assert sampling.uniform_sample(samples, 1000).count() == 300


def test_sampling_does_not_depend_on_partitions(failing):
    one = sampling.uniform_sample(failing.coalesce(1), 20).collect()
    many = sampling.uniform_sample(failing.repartition(7), 20).collect()
    assert sorted(one) == sorted(many) and len(one) == 20


def test_uniform_sample_covers_the_range(make):
    samples = make(list(range(4000)), label=["a"] * 4000)
    picked = sampling.uniform_sample(samples, 1000).agg(F.avg("elapsed").alias("m")).first()["m"]
    assert abs(picked - 2000) < 150


def test_top_labels_break_ties_by_name(make):
    samples = make([1] * 5, label=["c", "b", "a", "a", "b"])
    rows = sampling.top_labels(samples, 2).orderBy(F.desc("rows"), "label").collect()
    assert [(r["label"], r["rows"]) for r in rows] == [("a", 2), ("b", 2)]


def test_a_rollup_tells_its_width(failing, tmp_path):
    wide = settle(rollup(failing, 10))
    assert series.throughput(wide, 20).count() == series.throughput(failing, 20).count()
    with pytest.raises(ValueError, match="rollup of 10 s"):
        series.throughput(wide, 5)
    plain = failing.withColumn("n", F.lit(3))
    assert sorted(series.throughput(plain).collect()) == sorted(series.throughput(failing).collect())


def test_rollup_serves_summaries(failing):
    rolled = rollup(failing)
    for operator in (summary.percentiles, summary.label_aggregate, summary.apdex):
        assert sorted(operator(failing).collect()) == sorted(operator(rolled).collect())
