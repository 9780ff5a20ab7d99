"""Time the headline queries on one machine; prints one JSON line.

The samples are derived from the events once and stored as Parquet, as ingest leaves
them; the queries then read the stored table.  ``queries`` holds warm times (the best
of three rounds after a first), ``cold`` the first round.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks import inputs  # noqa: E402
from loadgauge.operators import anomalies, charts, findings, segments, slo, summary  # noqa: E402
from loadgauge.session import SETTINGS  # noqa: E402
from loadgauge.sources import ingest, tables, xml_files  # noqa: E402
from loadgauge.streaming import live  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("loadgauge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.showConsoleProgress", "false")
        # 29 charts in one session have more generated classes than the default keeps.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action: Callable[[], None]) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    begin = time.perf_counter()
    spark = session()
    spark.range(1).count()
    startup = time.perf_counter() - begin

    path = inputs.fresh_folder(spark, "bench-samples")
    tables.write_samples(inputs.samples(spark, SF_DIR), path)
    samples = tables.read_samples(spark, path)
    files = inputs.write_csv_files(inputs.samples(spark, SF_DIR, "raw"))
    xml = inputs.write_xml_files(inputs.samples(spark, SF_DIR, "raw"))

    def load() -> None:
        out = inputs.fresh_folder(spark, "bench-ingest")
        run_id = inputs.run_of_folder(F.col("source_file"))
        ingest.ingest(spark, [f"{files}/*"], out, run_id)

    def stream() -> None:
        columns, delimiter = inputs.CSV_LAYOUTS["run-a"]
        header = delimiter.join(["dataType", *[inputs.CSV_NAMES[c] for c in columns]])
        raw = live.stream_jtl_csv(spark, f"{files}/run-a", header, delimiter)
        out, state = inputs.fresh_folder(spark, "live"), inputs.fresh_folder(spark, "state")
        live.write_live(raw, out, state).awaitTermination()
        run(live.bucket_metrics(live.read_live(spark, out)))

    def all_charts() -> None:
        charts.store_charts(samples, inputs.fresh_folder(spark, "charts"), at_once=int(CPUS))

    actions: dict[str, Callable[[], None]] = {
        "label_summary": lambda: run(summary.label_summary(samples)),
        "percentiles": lambda: run(summary.percentiles(samples)),
        "overall_percentiles": lambda: run(summary.overall_percentiles(samples)),
        "correlations": lambda: run(summary.correlations(samples)),
        "rt_spikes": lambda: run(anomalies.rt_spikes(samples)),
        "knee": lambda: run(anomalies.knee(samples)),
        "iqr_outliers": lambda: run(anomalies.iqr_outliers(samples)),
        "steady": lambda: run(segments.steady(samples)),
        "slo_compliance": lambda: run(slo.slo_compliance(samples)),
        "run_kpis": lambda: run(slo.run_kpis(samples)),
        "findings": lambda: run(findings.findings(samples)),
        "ingest_csv": load,
        "scan_xml": lambda: run(xml_files.read_jtl_xml(spark, f"{xml}/*")),
        "stream_csv": stream,
        "charts_29": all_charts,
    }
    if os.environ.get("BENCH_EACH"):
        for name in charts.CHARTS:
            actions[name] = lambda name=name: run(charts.chart(name, samples))
    cold = {name: round(timed(action), 4) for name, action in actions.items()}
    rounds = [{name: timed(action) for name, action in actions.items()} for _ in range(3)]
    warm = {name: round(min(times[name] for times in rounds), 4) for name in actions}
    result = {
        "metric": "warm seconds, all headline queries",
        "value": round(sum(warm[n] for n in warm if not n.startswith("fig-")), 4),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "session_start": round(startup, 4),
        "sf": SF_DIR.rsplit("sf", 1)[-1].strip("/"),
        "cpus": CPUS,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
