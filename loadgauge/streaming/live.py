"""Bucket metrics while result files are still arriving."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loadgauge.functions.columns import bucket_ms, is_error
from loadgauge.model import RUN_KEYS, run_keys
from loadgauge.plans.histogram import quantile, ranked
from loadgauge.plans.joining import settle
from loadgauge.sources.cleaning import REASON_FIELDS, assessment
from loadgauge.sources.csv_files import canonical_columns, column_positions, header_columns, open_quotes, read_broken_csv, read_jtl_csv
from loadgauge.sources.detect import literal_path
from loadgauge.sources.ingest import run_of_file
from loadgauge.streaming.compaction import KIND, compact, read_manifest, stored

MERGE_EVERY = 16
# Columns of a stream of files, and those that Spark's reader of files has.
FILE_FIELDS = ["path", "source_file", "run_id", "header", "delimiter"]
FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
# Column expressions of a stream by name.  Building those of a batch takes Python a second, in which Spark has
# nothing to do and other streams of the process wait, so they are built once a stream.
Built = dict[tuple[str, ...], list[Column]]
LEVELS = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def stream_jtl_csv(
    spark: SparkSession,
    folder: str,
    header: str,
    delimiter: str = ",",
    run_id: Column | None = None,
    files_per_trigger: int = 1000,
    multi_line: bool | None = None,
) -> DataFrame:
    """Raw strings with run_id from CSV files of one header, as they land in a folder.

    ``run_id`` is an expression over source_file; by default each file is a run.  Line breaks
    inside quotes belong to their field.  By default the stream is one of files, whose rows
    ``write_live`` reads, and a pass over their lines tells how (see ``read_files``), so that a file is
    worked on in as many tasks as it has splits.  ``multi_line`` says instead that any file may have
    such line breaks, so that each is read whole by one task, or that none has any.
    """
    run = run_of_file(F.col("source_file")) if run_id is None else run_id
    source = F.col("_metadata.file_path").alias("source_file")
    if multi_line is None:
        files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).load(folder)
        named = files.select("path", source).withColumn("run_id", run)
        return named.select(*FILE_FIELDS[:3], F.lit(header).alias("header"), F.lit(delimiter).alias("delimiter"))
    names = header_columns(header, delimiter)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("maxFilesPerTrigger", files_per_trigger)
        .csv(folder)
    )
    found = raw.select(*canonical_columns(column_positions(names)), source)
    return found.withColumn("run_id", run).drop("source_file")


def _once(built: Built, name: tuple[str, ...], build: Callable[[], list[Column]]) -> list[Column]:
    if name not in built:
        built[name] = build()
    return built[name]


def _line_facts(delimiter: str) -> list[Column]:
    """Of a line: whether it leaves a quote open, has carriage returns, is read otherwise by Spark's parser."""
    value, text = F.col("value"), F.regexp_replace("value", r"\r\z", "")
    open_end = F.contains(value, F.lit('"')) & open_quotes(value, delimiter)[0]
    returns = F.contains(value, F.lit("\r"))
    # A blank line sorts before "!", as hardly any other does; the patterns take longer than all else here.
    blank = (value < "!") & F.rlike(text, F.lit(r"\A[\x00-\x20]+\z"))
    odd = (returns & F.contains(text, F.lit("\r"))) | blank
    return [open_end.alias("open"), returns.alias("returns"), odd.alias("odd")]


def read_files(spark: SparkSession, files: DataFrame, built: Built | None = None) -> DataFrame:
    """Raw strings with run_id from one batch of files(path, source_file, run_id, header, delimiter).

    The rows are those of Spark's parser with ``multiLine``.  Files in which no line leaves a quoted field
    open are read line by line.  The others are put together from lines, but for the few on which
    line by line reading differs from that parser: carriage returns beside open quotes or inside lines,
    and lines of white space alone; each of these is read whole by one task.
    """
    named = files.collect()  # no more than files_per_trigger
    header, delimiter = named[0].header, named[0].delimiter
    lines = spark.read.option("lineSep", "\n").text([literal_path(f.path) for f in named])
    tests = _once({} if built is None else built, ("facts", delimiter), lambda: _line_facts(delimiter))
    # Most lines have none of the three; those need no group.
    told = lines.select(F.col("_metadata.file_path").alias("source_file"), *tests).filter("open OR returns OR odd")
    facts = told.groupBy("source_file").agg(F.max("open").alias("open"), F.max("returns").alias("returns"), F.max("odd").alias("odd"))
    kinds = {f.source_file: "whole" if f.odd or (f.open and f.returns) else "records" if f.open else "lines" for f in facts.collect()}
    paths: dict[str, list[str]] = {}
    for f in named:
        paths.setdefault(kinds.get(f.source_file, "lines"), []).append(literal_path(f.path))
    scans = []
    for kind, found in sorted(paths.items()):
        if kind == "records":
            scans.append(read_broken_csv(spark, found, header, delimiter))
        else:
            scans.append(read_jtl_csv(spark, found, header, delimiter, multi_line=kind == "whole"))
    rows = reduce(DataFrame.unionByName, scans)
    if len({f.run_id for f in named}) == 1:
        return rows.withColumn("run_id", F.lit(named[0].run_id).cast(files.schema["run_id"].dataType)).drop("source_file")
    return rows.join(settle(files.select("source_file", "run_id")), "source_file").drop("source_file")


def write_live(
    raw: DataFrame,
    out: str,
    checkpoint: str,
    b: int = 10,
    keys: Sequence[str] = RUN_KEYS,
    trigger: dict | None = None,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Start the query that stores a raw stream below ``out``: samples, quarantine and counts.

    Nothing is kept between batches and nothing is late: each batch stores its good and bad rows
    and its own counts per (keys, bucket, elapsed), which readers add up.  So the result does not
    depend on how files fall into batches, and runs may arrive in any order.  A repeated batch
    replaces its folders.  The folders carry the name of their checkpoint; going on with another
    checkpoint would read all files again, and is refused.  After ``merge_every`` batches their
    folders are merged (see ``compaction``), so a stream of any age leaves few.
    """
    if merge_every < 2:
        raise ValueError("merge_every must be 2 or more")
    spark = raw.sparkSession
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    manifest = read_manifest(spark, out)
    batches = _stored(spark, f"{out}/counts") and spark.read.parquet(f"{out}/counts").filter(F.col("stream") != stream).take(1)
    if batches or (manifest and manifest.stream != stream):
        raise ValueError(f"{out} belongs to another checkpoint")

    built: Built = {}

    def kind() -> list[Column]:
        return [F.when(F.col("reason") != "", "quarantine").otherwise("samples").alias("kind")]

    def counted() -> list[Column]:
        return [F.count(F.lit(1)).alias("n"), F.count_if(is_error()).alias("errors")]

    def save(batch: DataFrame, number: int) -> None:
        place = f"stream={stream}/batch={number}"
        raw_rows = read_files(spark, batch, built) if batch.columns == FILE_FIELDS else batch
        columns = raw_rows.columns
        assessed = raw_rows.select(*_once(built, ("assessed", *columns), lambda: assessment(columns)))
        assessed = assessed.select("*", *_once(built, ("kind",), kind))
        path = f"{out}/rows/{place}"
        assessed.write.mode("overwrite").partitionBy("kind").parquet(path)
        # Not the batch's own session, in which Spark plans without adapting to sizes.
        rows = spark.read.schema(assessed.schema).parquet(path).filter("kind = 'samples'")
        bucket = _once(built, ("bucket",), lambda: [bucket_ms("timestamp_ms", b).alias("bucket")])
        counts = rows.groupBy(*run_keys(keys), *bucket, "elapsed").agg(*_once(built, ("counted",), counted))
        counts.write.mode("overwrite").parquet(f"{out}/counts/{place}")
        # Only the batches before this one: it may run again, they may not.
        schemas = {"rows": T.StructType([f for f in assessed.schema if f != KIND] + [KIND]), "counts": counts.schema}
        compact(spark, out, stream, number, schemas, merge_every)

    return (
        raw.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _stored(spark: SparkSession, path: str) -> bool:
    """Whether a folder with rows exists; asked of Spark, whatever the store."""
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException:
        return False


def read_live(spark: SparkSession, out: str, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, elapsed, n, errors: the counts of all batches so far."""
    return (
        stored(spark, out, "counts")
        .groupBy(*run_keys(keys), F.timestamp_millis("bucket").alias("bucket"), "elapsed")
        .agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"))
    )


def live_samples(spark: SparkSession, out: str) -> DataFrame:
    """The good rows of all batches so far."""
    return stored(spark, out, "rows").filter("kind = 'samples'").drop("kind", *REASON_FIELDS)


def live_quarantine(spark: SparkSession, out: str) -> DataFrame:
    """The bad rows of all batches so far, with reason and text as read."""
    return stored(spark, out, "rows").filter("kind = 'quarantine'").select("run_id", *REASON_FIELDS)


def bucket_metrics(counts: DataFrame, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, bucket, error_count, total_count, error_rate, p50, p90, p95, p99."""
    by = [*run_keys(keys), "bucket"]
    return (
        ranked(counts, by)
        .groupBy(*by)
        .agg(
            F.sum("errors").alias("error_count"),
            F.sum("n").alias("total_count"),
            (F.sum("errors") / F.sum("n")).alias("error_rate"),
            *[quantile(p).alias(name) for name, p in LEVELS.items()],
        )
    )
