"""The data model: the samples table, source column names, SLO thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import types as T

# One run (one result file) is one value of run_id.  Every operator groups by its
# keys and partitions every window by them, so a job may hold thousands of runs.
RUN_KEYS = ("run_id",)

# The canonical sample columns.
SAMPLES_SCHEMA = T.StructType(
    [
        T.StructField("timestamp_ms", T.LongType()),
        T.StructField("elapsed", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("response_code", T.StringType()),
        T.StructField("response_message", T.StringType()),
        T.StructField("thread_name", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("failure_message", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("sent_bytes", T.LongType()),
        T.StructField("grp_threads", T.LongType()),
        T.StructField("all_threads", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("latency", T.LongType()),
        T.StructField("idle_time", T.LongType()),
        T.StructField("connect", T.LongType()),
    ]
)

QUARANTINE_SCHEMA = T.StructType(
    [
        T.StructField("row_index", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("raw_json", T.StringType()),
    ]
)

# Source header (lower case) -> canonical column.
HEADER_NAMES = {
    "timestamp": "timestamp_ms",
    "ts": "timestamp_ms",
    "elapsed": "elapsed",
    "label": "label",
    "sampler_label": "label",
    "responsecode": "response_code",
    "response_code": "response_code",
    "responsemessage": "response_message",
    "response_message": "response_message",
    "threadname": "thread_name",
    "thread_name": "thread_name",
    "success": "success",
    "failuremessage": "failure_message",
    "failure_message": "failure_message",
    "errormessage": "failure_message",
    "bytes": "bytes",
    "sentbytes": "sent_bytes",
    "sent_bytes": "sent_bytes",
    "grpthreads": "grp_threads",
    "grp_threads": "grp_threads",
    "allthreads": "all_threads",
    "all_threads": "all_threads",
    "url": "url",
    "latency": "latency",
    "idletime": "idle_time",
    "idle_time": "idle_time",
    "connect": "connect",
}

# XML attribute -> canonical column.
XML_ATTRIBUTES = {
    "ts": "timestamp_ms",
    "t": "elapsed",
    "lb": "label",
    "rc": "response_code",
    "rm": "response_message",
    "tn": "thread_name",
    "s": "success",
    "by": "bytes",
    "sby": "sent_bytes",
    "ng": "grp_threads",
    "na": "all_threads",
    "lt": "latency",
    "it": "idle_time",
    "ct": "connect",
}


@dataclass(frozen=True)
class SloConfig:
    """Service-level thresholds; the defaults are fixed values."""

    p90_ms: float = 1000.0
    p99_ms: float = 3000.0
    error_rate_pct: float = 1.0
    apdex_t: float = 0.5


def run_keys(keys: Sequence[str]) -> list[str]:
    """The key columns as a list; at least one is needed.

    A table holding a single run gets a constant ``run_id`` from its reader.  Without
    a key every window would gather the whole table in one task.
    """
    found = [keys] if isinstance(keys, str) else list(keys)
    if not found:
        raise ValueError("keys must name at least one column, for example ('run_id',)")
    return found
