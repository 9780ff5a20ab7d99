"""The stored tables: samples and quarantine, partitioned by run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loadgauge.model import QUARANTINE_SCHEMA, SAMPLES_SCHEMA

RUN = T.StructField("run_id", T.StringType())


def write_samples(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Samples with run_id, one folder per run."""
    names = SAMPLES_SCHEMA.fieldNames()
    _write(samples.select(*names, "run_id"), path, mode)


def write_quarantine(quarantine: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Bad rows with run_id; without any, an empty table."""
    _write(quarantine.select(*QUARANTINE_SCHEMA.fieldNames(), "run_id"), path, mode)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    rows.write.mode(mode).partitionBy("run_id").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples with run_id; a filter on run_id prunes folders."""
    return spark.read.schema(T.StructType([*SAMPLES_SCHEMA.fields, RUN])).parquet(path)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*QUARANTINE_SCHEMA.fields, RUN])).parquet(path)
