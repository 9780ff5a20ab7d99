"""Load-test result analytics as Spark DataFrame operators."""

from loadgauge.model import RUN_KEYS, SAMPLES_SCHEMA, SloConfig

__all__ = ["RUN_KEYS", "SAMPLES_SCHEMA", "SloConfig"]
