"""Batch folders of a stream, merged level by level; a manifest says which folders count.

Below a stream's ``out`` lie ``counts`` and ``rows`` with a folder per batch, ``merged`` with a
folder per segment (a range of batches), and ``manifest``.  ``fan`` batches make a segment of
level 1, ``fan`` segments of a level one of the next, so n batches leave about ``fan`` folders a
level and each row is written again once a level.

A merge writes its segment first and then a manifest, one file that appears whole or not at all.
Until it does, readers follow the manifest before, whose folders are all still there; a merge that
stops halfway is written anew by the next one.  What a manifest replaces is deleted by the merge
after it, so readers have that long to finish.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.session import side_by_side

PLACE = [T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())]
RANGE = T.StructField("batches", T.StringType())
KIND = T.StructField("kind", T.StringType())
COUNTED = ("n", "errors")


@dataclass(frozen=True)
class Segment:
    first: int
    upto: int  # the first batch that is not in it
    level: int

    def path(self, out: str, table: str) -> str:
        return f"{out}/merged/{table}/batches={self.first}-{self.upto}"


@dataclass(frozen=True)
class Manifest:
    """Batches below ``upto`` are in ``segments``, in order; ``retired`` folders wait for deletion."""

    stream: str
    version: int = 0
    upto: int = 0
    segments: list[Segment] = field(default_factory=list)
    retired: list[str] = field(default_factory=list)
    schemas: dict[str, str] = field(default_factory=dict)


def read_manifest(spark: SparkSession, out: str) -> Manifest | None:
    """The newest manifest; null before the first merge."""
    try:
        reader = spark.read.schema("version long, manifest string").option("ignoreMissingFiles", True)
        newest = reader.parquet(f"{out}/manifest/*")
    except AnalysisException:  # no such folder
        return None
    found = newest.agg(F.max_by("manifest", "version")).first()[0]
    if found is None:
        return None
    fields = json.loads(found)
    return Manifest(**fields | {"segments": [Segment(**s) for s in fields["segments"]]})


def _commit(spark: SparkSession, out: str, manifest: Manifest) -> None:
    """Write the manifest over the one before the newest, which stays until this one is there."""
    # Made of literals: rows of Python would start a Python worker for it.
    text = F.lit(json.dumps(asdict(manifest)))
    table = spark.range(1, numPartitions=1).select(F.lit(manifest.version).cast("long").alias("version"), text.alias("manifest"))
    table.write.mode("overwrite").parquet(f"{out}/manifest/slot-{manifest.version % 2}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(spark: SparkSession, out: str, table: str) -> DataFrame:
    """All rows of ``counts`` or ``rows``, whichever folders they lie in."""
    manifest = read_manifest(spark, out)
    if manifest is None:
        return spark.read.parquet(f"{out}/{table}").drop("stream", "batch")
    plain = _schema(manifest, table)
    batches = spark.read.schema(T.StructType([*plain, *PLACE])).parquet(f"{out}/{table}")
    rows = batches.filter(F.col("batch") >= manifest.upto).drop("stream", "batch")
    return rows.unionByName(_merged(spark, out, table, manifest))


def _merged(spark: SparkSession, out: str, table: str, manifest: Manifest) -> DataFrame:
    """The rows of a manifest's segments."""
    schema = T.StructType([*_schema(manifest, table), RANGE])
    reader = spark.read.schema(schema).option("basePath", f"{out}/merged/{table}")
    return reader.parquet(*[s.path(out, table) for s in manifest.segments]).drop(RANGE.name)


def _schema(manifest: Manifest, table: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(manifest.schemas[table]))


def compact(spark: SparkSession, out: str, stream: str, below: int, schemas: dict[str, T.StructType], fan: int) -> bool:
    """Merge the batches below ``below`` if there are ``fan`` or more of them; say whether it did.

    All batches below ``below`` must be complete, and only one job may merge at a time: the stream
    calls this at the end of each batch, for the batches before it.
    """
    if below < fan:
        return False
    old = read_manifest(spark, out) or Manifest(stream)
    if below - old.upto < fan:
        return False
    texts = {table: json.dumps(schema.jsonValue()) for table, schema in schemas.items()}
    kept, absorbed, level = old.segments, [], 1
    while len(kept) >= fan - 1 and all(s.level == level for s in kept[1 - fan :]):
        kept, absorbed = kept[: 1 - fan], kept[1 - fan :] + absorbed
        level += 1
    segment = Segment(absorbed[0].first if absorbed else old.upto, below, level)
    parts = replace(old, segments=absorbed, schemas=texts)
    side_by_side(spark, lambda table: _merge(spark, out, table, parts, segment), schemas)
    names = [f"{out}/{table}/stream={stream}/batch={n}" for table in schemas for n in range(old.upto, below)]
    names += [s.path(out, table) for table in schemas for s in absorbed]
    _commit(spark, out, Manifest(stream, old.version + 1, below, [*kept, segment], names, texts))
    for folder in old.retired:
        _delete(spark, folder)
    return True


def _merge(spark: SparkSession, out: str, table: str, parts: Manifest, segment: Segment) -> None:
    """Write the rows of ``parts`` and of the batches up to the segment's end as one segment.

    Counts of the same key are added up; rows only move to larger files, without a shuffle.
    """
    plain = _schema(parts, table)
    batches = spark.read.schema(T.StructType([*plain, *PLACE])).parquet(f"{out}/{table}")
    rows = batches.filter((F.col("batch") >= parts.upto) & (F.col("batch") < segment.upto)).drop("stream", "batch")
    if parts.segments:
        rows = rows.unionByName(_merged(spark, out, table, parts))
    if table == "counts":
        keys = [name for name in rows.columns if name not in COUNTED]
        rows.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in COUNTED]).write.mode("overwrite").parquet(segment.path(out, table))
    else:
        rows.write.mode("overwrite").partitionBy(KIND.name).parquet(segment.path(out, table))
