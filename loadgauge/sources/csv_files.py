"""CSV result files as raw strings under canonical names."""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgauge.model import HEADER_NAMES, SAMPLES_SCHEMA
from loadgauge.plans.joining import settle

CANONICAL = SAMPLES_SCHEMA.fieldNames()
PLACED_SCHEMA = "path string, source_file string, delimiter string, header string, whole boolean, width int, positions array<int>"
# Separator and quote that no text file holds: each line is one field of Spark's CSV reader.
NO_MARK, NO_QUOTE = "\uffff\ufffe\uffff", "\uffff"

# The functions that place columns travel to the executors, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def header_columns(header: str, delimiter: str = ",") -> list[str]:
    return next(csv.reader([header.lstrip("﻿")], delimiter=delimiter), [])


def column_positions(names: Sequence[str]) -> dict[str, int]:
    """Canonical column -> position of its source column.

    A source column that already has the canonical name wins, then the leftmost.  Others
    are dropped.
    """
    found: dict[str, int] = {}
    for position, name in enumerate(names):
        if name in CANONICAL:
            found.setdefault(name, position)
    for position, name in enumerate(names):
        canonical = HEADER_NAMES.get(name.lower())
        if name not in CANONICAL and canonical is not None:
            found.setdefault(canonical, position)
    return found


def map_columns(raw: DataFrame) -> DataFrame:
    """The canonical subset of a frame with source column names."""
    names = raw.columns
    placed = raw.toDF(*[f"c{i}" for i in range(len(names))])
    return placed.select(*canonical_columns(column_positions(names)))


def canonical_columns(positions: dict[str, int]) -> list[Column]:
    return [F.col(f"c{positions[name]}").alias(name) for name in CANONICAL if name in positions]


@dataclass(frozen=True)
class Layouts:
    """Where the canonical columns stand in each of any number of CSV files.

    ``files`` holds path, source_file, delimiter, header, whole (whether fields may hold line breaks), width and
    positions (one per canonical column, null where the file lacks it), or is None if ``positions``
    holds for every file.  Only what the plan needs comes to the driver: the delimiters in use, the
    longest header, the columns that any file has, which values of whole there are.
    """

    delimiters: list[str]
    width: int
    present: list[str]
    files: DataFrame | None = None
    positions: list[int | None] | None = None
    kinds: tuple[bool, ...] = ()

    def attach(self, lines: DataFrame) -> DataFrame:
        """The lines of these files, with delimiter and positions."""
        if self.files is None:
            places = F.array(*[F.lit(p).cast("int") for p in self.positions])
            return lines.withColumns({"delimiter": F.lit(self.delimiters[0]), "positions": places})
        return lines.join(self.files.select("source_file", "delimiter", "positions"), "source_file")

    def only(self, whole: bool) -> Layouts:
        """The same for the files whose fields may, or may not, hold line breaks."""
        return replace(self, files=self.files.filter(F.col("whole") == whole))


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        names = [header_columns(h, d) for h, d in zip(batch["header"], batch["delimiter"], strict=True)]
        found = [column_positions(n) for n in names]
        places = [[f.get(name) for name in CANONICAL] for f in found]
        yield batch[["path", "source_file", "delimiter", "header", "whole"]].assign(width=[len(n) for n in names], positions=places)


def layouts_of(files: DataFrame, delimiter: str | None = None) -> Layouts:
    """The layouts of CSV files from path, source_file, delimiter and header, as ``classify_inputs`` gives them, and whole."""
    mark = F.col("delimiter") if delimiter is None else F.lit(delimiter).alias("delimiter")
    placed = settle(files.select("path", "source_file", mark, "header", "whole").mapInPandas(_place, PLACED_SCHEMA))
    has = [F.max(F.get("positions", F.lit(i))).isNotNull().alias(name) for i, name in enumerate(CANONICAL)]
    facts = placed.agg(F.sort_array(F.collect_set("delimiter")).alias("marks"), F.max("width").alias("width"), F.collect_set("whole").alias("whole"), *has).first()
    return Layouts(facts.marks, facts.width or 0, [name for name in CANONICAL if facts[name]], placed, None, tuple(sorted(facts.whole)))


def one_layout(header: str, delimiter: str = ",") -> Layouts:
    """The layout of files that share one header."""
    names = header_columns(header, delimiter)
    found = column_positions(names)
    return Layouts([delimiter], len(names), [n for n in CANONICAL if n in found], None, [found.get(n) for n in CANONICAL])


def _by_delimiter(layouts: Layouts, value) -> Column:
    """``value(delimiter)``, worked out for the delimiter of the row's file."""
    first, *others = layouts.delimiters
    if not others:
        return value(first)
    cases = reduce(lambda case, mark: case.when(F.col("delimiter") == mark, value(mark)), others, F.when(F.col("delimiter") == first, value(first)))
    return cases


def _placed_fields(rows: DataFrame, layouts: Layouts, multi_line: bool = False) -> DataFrame:
    """Canonical raw strings and source_file from rows(source_file, value, delimiter, positions).

    A record is parsed into as many fields as the longest header has; its file's positions pick
    from them.  Surplus fields are dropped, missing ones null.
    """
    fields = ", ".join(f"c{i} string" for i in range(layouts.width))
    options = {"escape": '"', "mode": "PERMISSIVE", "multiLine": str(multi_line).lower()}
    record = _by_delimiter(layouts, lambda mark: F.from_csv("value", fields, {**options, "sep": mark}))
    parsed = rows.select("source_file", "positions", record.alias("r"))
    cells = parsed.select("source_file", "positions", F.array(*[F.col(f"r.c{i}") for i in range(layouts.width)]).alias("cells"))
    place = {name: F.get("positions", F.lit(i)) for i, name in enumerate(CANONICAL)}
    return cells.select(*[F.get("cells", place[name]).alias(name) for name in layouts.present], "source_file")


def read_placed_csv(spark: SparkSession, paths: Sequence[str] | str, layouts: Layouts) -> DataFrame:
    """Canonical raw strings and source_file from CSV files of any number of headers, in one scan.

    Spark's CSV reader skips each file's header and hands over whole lines; the layouts, one row per
    file, join them.  Files below the paths without a layout are left out.  No field may hold a line break.
    """
    found = (
        spark.read.schema("value string").option("header", True).option("sep", NO_MARK).option("quote", NO_QUOTE)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    return _placed_fields(layouts.attach(found.select("value", F.col("_metadata.file_path").alias("source_file"))), layouts)


def read_jtl_csv(
    spark: SparkSession,
    paths: Sequence[str] | str,
    header: str,
    delimiter: str = ",",
    multi_line: bool = False,
) -> DataFrame:
    """Canonical raw strings and source_file from CSV files that share one header.

    Spark applies one header to all files of a scan, so files with another header need a
    scan of their own.  Surplus fields are dropped, missing ones null.  Line breaks
    inside quotes need ``multi_line``, which keeps files from being split.
    """
    names = header_columns(header, delimiter)
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", delimiter)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", multi_line)
        .csv(paths if isinstance(paths, str) else list(paths))
    )
    source = F.col("_metadata.file_path").alias("source_file")
    return raw.select(*canonical_columns(column_positions(names)), source)


def open_quotes(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a line leaves a quoted field open, if it begins outside of one, and if inside.

    Only a quote at the beginning of a field opens it; any other is text, as for Spark's parser.
    """
    other = rf"[^{re.escape(delimiter)}]*+"
    quoted = r'"(?:[^"]|"")*+"'
    field = rf'(?:{quoted}{other}|(?!"){other})'
    rest = rf"{re.escape(delimiter)}(?:{field}{re.escape(delimiter)})*+"
    opened = r'"(?:[^"]|"")*+$'
    outside = F.rlike(line, F.lit(rf"(?s)^(?:{field}{re.escape(delimiter)})*+{opened}"))
    inside = F.rlike(line, F.lit(rf'(?s)^(?:(?:[^"]|"")*+$|(?:[^"]|"")*+"{other}{rest}{opened})'))
    return outside, inside


def _records(lines: DataFrame, layouts: Layouts) -> DataFrame:
    """lines(source_file, split, id, value, delimiter) -> source_file, split, id, value, a row per record.

    A line maps the state it begins in (outside or inside quotes) to the one it ends in: it keeps it,
    swaps it, or fixes it.  So the state behind a line is that of the last line before it that
    fixed one, swapped as often as lines since then swap; the splits of a file are put together by the
    same rule.  Lines of records of one line stay where they are; the others go on to their first.
    """
    outside = _by_delimiter(layouts, lambda mark: open_quotes(F.col("value"), mark)[0])
    inside = _by_delimiter(layouts, lambda mark: open_quotes(F.col("value"), mark)[1])
    file_split = ["source_file", "split"]
    kinds = lines.select(*file_split, "id", outside.alias("out"), inside.alias("in"))
    kinds = settle(kinds.select(*file_split, "id", (F.col("out") & ~F.col("in")).cast("int").alias("swap"), F.when(F.col("out") == F.col("in"), F.col("out").cast("int")).alias("fixed"), "out"))

    def state(window, swap: Column, fixed: Column) -> Column:
        # A fixed state, freed of the swaps up to its place; those up to here are added again.
        swaps = F.coalesce(F.sum(swap).over(window), F.lit(0))
        return F.struct(swaps.alias("swaps"), F.last(fixed, ignorenulls=True).over(window).alias("fixed"))

    in_split = Window.partitionBy(*file_split).orderBy("id")
    running = kinds.withColumn("upto", F.sum("swap").over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
    running = running.withColumn("fixed", F.pmod(F.col("fixed") - F.col("upto"), F.lit(2)))
    before = in_split.rowsBetween(Window.unboundedPreceding, -1)
    running = running.withColumn("s", state(before, F.col("swap"), F.col("fixed")))
    ends = running.groupBy(*file_split).agg(F.sum("swap").alias("swap"), F.max_by("fixed", F.when(F.col("fixed").isNotNull(), F.col("id"))).alias("fixed"))
    by_split = Window.partitionBy("source_file").orderBy("split")
    ends = ends.withColumn("upto", F.sum("swap").over(by_split.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("fixed", F.pmod(F.col("fixed") - F.coalesce("upto", F.lit(0)), F.lit(2)))
    first = ends.select(*file_split, state(by_split.rowsBetween(Window.unboundedPreceding, -1), F.col("swap"), F.col("fixed")).alias("f"))
    entered = F.pmod(F.coalesce("f.fixed", F.lit(0)) + F.col("f.swaps"), F.lit(2))
    begun = running.join(first.select(*file_split, entered.alias("entered")), file_split)
    within = F.pmod(F.coalesce("s.fixed", "entered") + F.col("s.swaps"), F.lit(2)) == 1
    begun = begun.select(*file_split, "id", within.alias("within"), F.col("out"))
    upto_here = in_split.rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(~F.col("within"), F.col("id")), ignorenulls=True)
    placed = begun.withColumn("owner", owner.over(upto_here))
    lasts = placed.groupBy(*file_split).agg(F.max("owner").alias("last"))
    carried = F.last("last", ignorenulls=True).over(by_split.rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.join(lasts.select(*file_split, carried.alias("carried")), file_split)
    parts = settle(placed.filter("within OR out").select("id", F.coalesce("owner", "carried").alias("owner")))
    alone = lines.join(parts, "id", "left_anti").select(*file_split, "id", "value")
    part = F.struct("split", "id", "value")
    joined = lines.join(parts, "id").groupBy("source_file", "owner").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    joined = joined.select("source_file", F.get("parts.split", F.lit(0)).alias("split"), F.col("owner").alias("id"), F.array_join("parts.value", "\n").alias("value"))
    return alone.unionByName(joined)


def read_broken_csv(spark: SparkSession, paths: Sequence[str] | str, header: str, delimiter: str = ",") -> DataFrame:
    """Like ``read_jtl_csv`` with ``multi_line``, but a file is worked on in as many tasks as it has splits."""
    return read_placed_records(spark, paths, one_layout(header, delimiter))


def read_placed_records(spark: SparkSession, paths: Sequence[str] | str, layouts: Layouts) -> DataFrame:
    """Like ``read_placed_csv``, for files whose fields may hold line breaks.

    Lines are read as text and put together to records, also over splits.  Line breaks inside quotes
    stay as the file has them (Spark's parser shortens those of two characters).  The first record of a
    file that is not blank is its header.  A quote that is never closed takes the rest of its file, as
    it does for Spark's parser.
    """
    found = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    lines = found.select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"), "value",
    )
    lines = settle(layouts.attach(lines).drop("positions"))
    records = _records(lines, layouts).filter(F.trim(F.replace("value", F.lit("\r"))) != "")
    headers = records.groupBy("source_file").agg(F.min(F.struct("split", "id")).alias("h")).select(F.col("h.id").alias("id"))
    rows = records.join(settle(headers), "id", "left_anti")
    text = F.when(F.endswith("value", F.lit("\r")), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return _placed_fields(layouts.attach(rows.select("source_file", text.alias("value"))), layouts, multi_line=True)
