"""Session and small literal samples."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loadgauge.model import SAMPLES_SCHEMA  # noqa: E402
from loadgauge.session import SETTINGS  # noqa: E402

BASE_TS = 1_700_000_000_000


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("loadgauge-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make(spark):
    """make(elapsed, ...): samples one second apart, labels Home and API in turn."""

    def build(elapsed, success=None, label=None, ts=None, run_id="run-1", **columns):
        rows = []
        for i, ms in enumerate(elapsed):
            ok = True if success is None else success[i]
            row = {
                "timestamp_ms": BASE_TS + 1000 * i if ts is None else ts[i],
                "elapsed": ms,
                "label": ("Home" if i % 2 == 0 else "API") if label is None else label[i],
                "response_code": "200" if ok else "500",
                "response_message": "OK" if ok else "Error",
                "thread_name": "Thread-1",
                "success": ok,
                "failure_message": "" if ok else "Error",
                "bytes": 1024,
                "sent_bytes": 256,
                "grp_threads": 10,
                "all_threads": 10,
                "url": "http://example.com",
                "latency": None if ms is None else max(0, ms - 10),
                "idle_time": 0,
                "connect": 10,
            }
            row |= {name: values[i] for name, values in columns.items()}
            rows.append(tuple(row[f.name] for f in SAMPLES_SCHEMA))
        return spark.createDataFrame(rows, SAMPLES_SCHEMA).withColumn("run_id", F.lit(run_id))

    return build


@pytest.fixture(scope="session")
def fast(make):
    return make([20 + i % 30 for i in range(200)])


@pytest.fixture(scope="session")
def slow(make):
    return make([5000 + i % 1000 for i in range(200)])


@pytest.fixture(scope="session")
def failing(make):
    return make([100 + i % 400 for i in range(200)], success=[i % 5 != 0 for i in range(200)])


@pytest.fixture(scope="session")
def spike(make):
    return make([200] * 90 + [5000] * 10)


@pytest.fixture(scope="session")
def tail(make):
    return make([100] * 90 + [3000] * 10)


@pytest.fixture(scope="session")
def bursts(make):
    ts = [
        BASE_TS + 10_000 * span + i * (10_000 // size)
        for span, size in enumerate((50, 5, 80))
        for i in range(size)
    ]
    return make([100 + i % 50 for i in range(len(ts))], ts=ts)
