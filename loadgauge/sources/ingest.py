"""From result files to stored samples, quarantine and summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.model import QUARANTINE_SCHEMA, SAMPLES_SCHEMA
from loadgauge.operators.summary import label_aggregate
from loadgauge.plans.joining import settle
from loadgauge.sources.cleaning import assess
from loadgauge.sources.csv_files import Layouts, layouts_of, read_jtl_csv, read_placed_csv, read_placed_records
from loadgauge.sources.detect import classify_inputs, literal_path
from loadgauge.sources.tables import RUN
from loadgauge.sources.xml_files import read_jtl_xml

FEW_FILES = 500  # files named one by one in a scan
FEW_HEADERS = 4  # headers of such files that get a scan of their own

SUMMARY_SCHEMA = (
    "label string, count long, mean_elapsed double, p50 double, p90 double, p95 double, "
    "p99 double, error_rate double, min_elapsed long, max_elapsed long, run_id string"
)


def run_of_file(path: Column) -> Column:
    """File name without its ending, and a digest of the whole path: equal names stay apart."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat_ws("-", stem, F.md5(path.cast("binary")))


def with_line_breaks(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """source_file of the files that hold a line with an odd number of quotes: a field goes on in the next."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"')))
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return lines.filter(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("source_file")).distinct()


def _places(files: DataFrame, paths: Sequence[str] | str) -> Sequence[str] | str:
    """What to scan for files: their paths if these are few, so that no other file is read, else all paths.

    Scans keep the rows of their own files by a join, so this decides what is read, never the result.
    """
    few = [r.path for r in files.select("path").limit(FEW_FILES + 1).collect()]
    return [literal_path(p) for p in few] if len(few) <= FEW_FILES else paths


def _plain_scans(spark: SparkSession, paths: Sequence[str] | str, layouts: Layouts) -> list[DataFrame]:
    """One scan for any number of headers; a few headers of few files get a scan each.

    Spark's CSV parser knows one header a scan, and is faster by a quarter than placing fields by file.
    The rows are the same.
    """
    few = layouts.files.select("path", "delimiter", "header").limit(FEW_FILES + 1).collect()
    if len(few) > FEW_FILES:
        return [read_placed_csv(spark, paths, layouts)]
    groups: dict[tuple[str, str], list[str]] = {}
    for file in few:
        groups.setdefault((file.delimiter, file.header), []).append(literal_path(file.path))
    if len(groups) > FEW_HEADERS:
        return [read_placed_csv(spark, [name for names in groups.values() for name in names], layouts)]
    return [read_jtl_csv(spark, names, header, mark) for (mark, header), names in sorted(groups.items())]


def read_raw(
    spark: SparkSession,
    paths: Sequence[str] | str,
    multi_line: bool | None = None,
    delimiter: str | None = None,
    kinds: DataFrame | None = None,
) -> DataFrame:
    """Raw strings of all files, with source_file; one scan per kind of file, and a few at most for CSV headers.

    A table of one row per file says where its columns stand and joins the lines, so neither the plan
    nor the driver grows with files or headers.  CSV files with line breaks inside quotes are found by a
    pass over all lines and put together from lines; ``multi_line`` says instead that all or none have
    any.  Either are split.  A file that is neither CSV nor XML raises.  ``kinds`` is the stored result
    of ``classify_inputs``.
    """
    kinds = settle(classify_inputs(spark, paths)) if kinds is None else kinds
    formats = {r.format: r.path for r in kinds.groupBy("format").agg(F.min("path").alias("path")).collect()}
    for other in sorted(set(formats) - {"csv", "xml"}):
        raise ValueError(f"neither CSV nor XML results: {formats[other]} and maybe more")
    scans = []
    if "csv" in formats:
        files = kinds.filter("format = 'csv'")
        places = _places(files, paths)
        if multi_line is None:
            odd = with_line_breaks(spark, places).withColumn("whole", F.lit(True))
            files = files.join(odd, "source_file", "left").fillna(False, "whole")
        else:
            files = files.withColumn("whole", F.lit(multi_line))
        layouts = layouts_of(files, delimiter)
        for whole in layouts.kinds:
            part = layouts.only(whole)
            if whole:
                scans.append(read_placed_records(spark, places if len(layouts.kinds) == 1 else _places(part.files, paths), part))
            else:
                scans += _plain_scans(spark, paths, part)
    if "xml" in formats:
        files = kinds.filter("format = 'xml'").select("path", "source_file")
        only = files if len(formats) > 1 else None
        scans.append(read_jtl_xml(spark, _places(files, paths), only))
    if not scans:
        raise ValueError(f"no files below {paths}, or all of them neither CSV nor XML results")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def ingest_counts(assessed: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """keys, parsed_rows, error_rows, total_rows of assessed rows."""
    return assessed.groupBy(*keys).agg(
        F.count_if(F.col("reason") == "").alias("parsed_rows"),
        F.count_if(F.col("reason") != "").alias("error_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


@dataclass(frozen=True)
class Ingested:
    samples: DataFrame
    quarantine: DataFrame
    counts: DataFrame
    summary: DataFrame


def ingest(
    spark: SparkSession,
    paths: Sequence[str] | str,
    out: str,
    run_id: Column | None = None,
    multi_line: bool | None = None,
    delimiter: str | None = None,
    mode: str = "errorifexists",
    strict: bool = False,
) -> Ingested:
    """Read, clean and store result files; return the stored tables.

    The files are parsed once: good and bad rows go out in the same job, into the folders
    kind=samples and kind=quarantine, each with one folder per run.  The summary per
    label is computed from the stored columns and stored beside them.  ``run_id`` is an
    expression over source_file; by default each file is a run of its own.  Files that are no
    results go to ``rejected`` with the reason, or raise if ``strict``.
    """
    out = out.rstrip("/")
    kinds = settle(classify_inputs(spark, paths))
    unknown = F.col("format") == "unknown"
    if not strict:
        reason = F.lit("neither CSV nor XML results").alias("reason")
        kinds.filter(unknown).select("path", "bytes", reason).write.mode(mode).parquet(f"{out}/rejected")
        kinds = kinds.filter(~unknown)
    raw = read_raw(spark, paths, multi_line, delimiter, kinds)
    run = run_of_file(F.col("source_file")) if run_id is None else run_id
    assessed = assess(raw.withColumn("run_id", run).drop("source_file"))
    bad = F.col("reason") != ""
    # Stored rows of either kind leave the columns of the other empty.
    stored = assessed.select(
        *[F.when(~bad, F.col(c)).alias(c) for c in SAMPLES_SCHEMA.fieldNames()],
        *[F.when(bad, F.col(c)).alias(c) for c in QUARANTINE_SCHEMA.fieldNames()],
        F.when(bad, "quarantine").otherwise("samples").alias("kind"),
        "run_id",
    )
    stored.write.mode(mode).partitionBy("kind", "run_id").parquet(f"{out}/rows")
    summary = label_aggregate(_stored_samples(_stored_rows(spark, out)))
    # All rows of a run in one task: one small file per run.
    summary.repartition("run_id").write.mode(mode).partitionBy("run_id").parquet(f"{out}/summary")
    return open_ingested(spark, out)


def _stored_rows(spark: SparkSession, out: str) -> DataFrame:
    kind = T.StructField("kind", T.StringType())
    fields = [*SAMPLES_SCHEMA.fields, *QUARANTINE_SCHEMA.fields, kind, RUN]
    return spark.read.schema(T.StructType(fields)).parquet(f"{out}/rows")


def _stored_samples(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'samples'").select(*SAMPLES_SCHEMA.fieldNames(), "run_id")


def open_ingested(spark: SparkSession, out: str) -> Ingested:
    """The tables an earlier ingest stored."""
    out = out.rstrip("/")
    rows = _stored_rows(spark, out)
    samples = _stored_samples(rows)
    good = F.col("kind") == "samples"
    counts = rows.groupBy("run_id").agg(
        F.count_if(good).alias("parsed_rows"),
        F.count_if(~good).alias("error_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )
    quarantine = rows.filter(~good).select(*QUARANTINE_SCHEMA.fieldNames(), "run_id")
    summary = spark.read.schema(SUMMARY_SCHEMA).parquet(f"{out}/summary")
    return Ingested(samples, quarantine, counts, summary)
