"""Session settings the operators are written for."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

# UTC: buckets are instants, but text timestamps and printed times are read as UTC.
# Output writers: ingest stores a task's rows of several runs and kinds without sorting them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.maxConcurrentOutputFileWriters": "32",
}

_local_folder: tempfile.TemporaryDirectory | None = None


def apply_settings(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def side_by_side(spark: SparkSession, job: Callable[[Any], None], items: Iterable[Any]) -> None:
    """Run a few jobs that share nothing at a time; one that fails raises when all have ended.

    Each thread has a copy of the local properties of this one, so what cancels this one's jobs cancels theirs.
    """
    found = list(items)
    with ThreadPoolExecutor(max(1, len(found))) as pool:
        done = [pool.submit(inheritable_thread_target(spark)(job), item) for item in found]
    for job_done in done:
        job_done.result()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, where driver and executors share one machine, may fall back
    on a temporary folder.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if _local_folder is None:
        _local_folder = tempfile.TemporaryDirectory(prefix="loadgauge-")
    return _local_folder.name
