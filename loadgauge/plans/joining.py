"""Joins of small fact tables (one row per run or per label) to large ones."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgauge.session import shared_folder


def settle(facts: DataFrame) -> DataFrame:
    """Write a fact table to the shared folder once and read it back.

    A join then sees its true file size: below spark.sql.autoBroadcastJoinThreshold
    Spark broadcasts it and leaves the samples unshuffled, above it falls back to a
    sort-merge join, whose hot keys AQE splits.  Left lazy, the size of an aggregate is
    guessed from its input, and the samples would be shuffled for a table of a few rows.
    A lost executor re-reads the files.
    """
    spark = facts.sparkSession
    path = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    facts.write.parquet(path)
    return spark.read.schema(facts.schema).parquet(path)


def join_facts(
    rows: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi-join that also matches null keys, so a missing label keeps its rows."""
    renamed = facts.withColumnsRenamed({name: f"__{name}" for name in on})
    matches = reduce(
        lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"__{name}")) for name in on]
    )
    joined = rows.join(renamed, matches, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{n}" for n in on])
