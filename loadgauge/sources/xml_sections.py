"""Comments, CDATA sections and processing instructions in XML that is read tag by tag.

A ``<`` inside such a section begins a record like any other, so what a record means depends on
the state that the text before it leaves: markup, comment, CDATA or instruction.  Only few records
change the state: those that open a section without closing it, and those that hold a closing
mark.  Over these, each block of a split yields a function from the state it is entered in to the
state it is left in; one row per block, put together in order, gives every block's first
state, and a second walk the ranges of records that begin inside a section.  A block has at most
2^16 records and a task a bounded number of them, whatever the size of splits and files.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.plans.joining import settle

# The functions below travel to the executors, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKUP, COMMENT, CDATA, INSTRUCTION = range(4)
# How sections begin (behind the <) and end.
SECTIONS = {COMMENT: ("!--", "-->"), CDATA: ("![CDATA[", "]]>"), INSTRUCTION: ("?", "?>")}
# Records are worked on in blocks of ids: a file's records in the order of (split, block, id).
BLOCK = ["source_file", "split", "block"]
BLOCK_BITS = 16
TASK_BITS, LEAST_BITS = 19, 13  # records of a task, and those too few to give them a task


def opens(value: Column) -> Column:
    """The section that a record opens in markup and leaves open; 0 if none."""
    found = F.lit(MARKUP)
    for state, (begin, end) in SECTIONS.items():
        inside = F.substr(value, F.lit(len(begin) + 1))
        found = F.when(F.startswith(value, F.lit(begin)) & ~F.contains(inside, F.lit(end)), state).otherwise(found)
    return found.cast("tinyint")


def closes(value: Column) -> Column:
    """Bit i - 1 says that the record holds the end of section i."""
    bits = [F.when(F.contains(value, F.lit(end)), 1 << (state - 1)).otherwise(0) for state, (_, end) in SECTIONS.items()]
    return (bits[0] + bits[1] + bits[2]).cast("tinyint")


def begins_cdata(value: Column) -> Column:
    return F.startswith(value, F.lit(SECTIONS[CDATA][0]))


def _behind(state: int, opened: int, closed: int) -> int:
    """The state behind a record that begins in ``state``."""
    if state == MARKUP:
        return opened
    return MARKUP if closed >> (state - 1) & 1 else state


def block_of(record: Column) -> Column:
    return F.shiftright(record, BLOCK_BITS)


def latest(record: Column, fact: Column, name: str) -> Column:
    """The aggregate struct(id, ``name``) of the latest record; null ids do not count, null if there is no other.

    Of numbers alone, which Spark keeps in a hash table of one row per group; for the maximum of a
    struct it would sort all rows of a split, which grows with the files.
    """
    return F.when(F.max(record).isNotNull(), F.struct(F.max(record).alias("id"), F.max_by(fact, record).alias(name)))


@dataclass(frozen=True)
class Blocks:
    """One row per block of records, with its first and last id, and the number of tasks for all records.

    That number grows with the records, so that a task's share does not.
    """

    table: DataFrame
    tasks: int

    def dealt(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(self.tasks, *(keys or BLOCK))


def blocks_of(records: DataFrame) -> Blocks:
    """The blocks of records(source_file, split, block, id, ...)."""
    ends = F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")
    table = settle(records.groupBy(*BLOCK).agg(*ends))
    n = table.agg(F.sum("n")).first()[0] or 0
    cores = records.sparkSession.sparkContext.defaultParallelism
    return Blocks(table.drop("n"), 1 + min(max(n >> TASK_BITS, cores), n >> LEAST_BITS))


def _in_order(table: pa.Table) -> list[tuple[int, int, int]]:
    order = np.argsort(table.column("id").to_numpy(), kind="stable")
    return list(zip(*[table.column(c).take(order).to_pylist() for c in ("id", "opens", "closes")], strict=True))


def _function_of_block(table: pa.Table) -> pa.Table:
    """One row: the state behind the block for each state before it."""
    states = list(range(len(SECTIONS) + 1))
    for _, opened, closed in _in_order(table):
        states = [_behind(s, opened, closed) for s in states]
    return pa.table({c: table.column(c)[:1] for c in BLOCK} | {"left_in": pa.array([states], pa.list_(pa.int32()))})


def _first_states(table: pa.Table) -> pa.Table:
    """The states before and behind each block of a file; blocks without marks change nothing."""
    order = np.lexsort([table.column("block").to_numpy(), table.column("split").to_numpy()])
    state, before, behind = MARKUP, [], []
    functions = table.column("left_in").take(order).to_pylist()
    for left_in in functions:
        before.append(state)
        state = state if left_in is None else left_in[state]
        behind.append(state)
    columns = {c: table.column(c).take(order) for c in [*BLOCK, "first_id", "last_id"]}
    states = {"before": pa.array(before, pa.int32()), "behind": pa.array(behind, pa.int32())}
    return pa.table(columns | states | {"marked": pa.array([f is not None for f in functions], pa.bool_())})


def _ranges(table: pa.Table) -> pa.Table:
    """begin, upto, state, opener: the ids of a block that begin inside a section.

    ``opener`` is the record that opens the section, null if an earlier block does; a section that the block's
    last record opens has no ids here.
    """
    state, last = table.column("before")[0].as_py(), table.column("last_id")[0].as_py()
    begin, opener, found = table.column("first_id")[0].as_py(), None, []
    for record, opened, closed in _in_order(table):
        after = _behind(state, opened, closed)
        if after != state:
            if state != MARKUP:
                found.append((begin, record, state, opener))
            state, begin, opener = after, record + 1, record
    if state != MARKUP:
        found.append((begin, last, state, opener))
    begins, uptos, states, openers = zip(*found, strict=True) if found else ((),) * 4
    columns = {c: pa.array([table.column(c)[0].as_py()] * len(found), table.schema.field(c).type) for c in BLOCK[:2]}
    ids = {name: pa.array(values, pa.int64()) for name, values in (("begin", begins), ("upto", uptos), ("opener", openers))}
    return pa.table(columns | {"begin": ids["begin"], "upto": ids["upto"], "state": pa.array(states, pa.int32()), "opener": ids["opener"]})


@dataclass(frozen=True)
class Sections:
    """``inside``: id and state of the records that begin inside a section.

    ``unclosed``: the id of the record whose section reaches the end of its file.
    """

    inside: DataFrame
    unclosed: DataFrame


def sections_of(records: DataFrame, blocks: Blocks) -> Sections | None:
    """The sections of records(source_file, split, block, id, opens, closes, ...); None if there are none.

    A file in which every section ends in the record that it begins in, as most do, is markup
    throughout and costs one look at the column opens.
    """
    if not records.filter("opens > 0").take(1):
        return None
    marks = settle(blocks.dealt(records.filter("opens > 0 OR closes > 0").select(*BLOCK, "id", "opens", "closes")))
    keys = "source_file string, split long"
    functions = blocks.dealt(marks).groupBy(*BLOCK).applyInArrow(_function_of_block, f"{keys}, block long, left_in array<int>")
    states = "block long, first_id long, last_id long, before int, behind int, marked boolean"
    in_files = blocks.table.join(settle(functions), BLOCK, "left").groupBy("source_file")
    first = settle(in_files.applyInArrow(_first_states, f"{keys}, {states}"))
    entered = blocks.dealt(marks.join(first.select(*BLOCK, "first_id", "last_id", "before"), BLOCK))
    fields = f"{keys}, begin long, upto long, state int, opener long"
    ranges = settle(entered.groupBy(*BLOCK).applyInArrow(_ranges, fields))
    whole = first.filter((F.col("before") != MARKUP) & ~F.col("marked"))
    whole = whole.select(F.col("first_id").alias("begin"), F.col("last_id").alias("upto"), F.col("before").alias("state"))
    spans = ranges.filter("begin <= upto").select("begin", "upto", "state").unionByName(whole)
    inside = settle(spans.select(F.explode(F.sequence("begin", "upto")).alias("id"), "state"))
    ends = first.groupBy("source_file").agg(F.max(F.struct(*BLOCK[1:], "behind")).alias("end")).filter(F.col("end.behind") != MARKUP)
    openers = ranges.filter("opener is not null").groupBy(*BLOCK[:2]).agg(F.max("opener").alias("opener"))
    openers = openers.groupBy("source_file").agg(F.max_by("opener", "split").alias("id"))
    unclosed = settle(openers.join(ends, "source_file").select("id"))
    return Sections(inside, unclosed)


def in_markup(rows: DataFrame, blocks: Blocks, sections: Sections | None) -> DataFrame:
    """The rows that begin outside of every section, dealt out by id."""
    rows = blocks.dealt(rows, "id")
    return rows if sections is None else rows.join(blocks.dealt(sections.inside, "id"), "id", "left_anti")


def continued_texts(records: DataFrame, blocks: Blocks, sections: Sections | None) -> DataFrame | None:
    """id, more: what CDATA sections add to the text of the record ``id`` that names a child.

    The text of a child goes on over the records behind it as long as these begin a CDATA section or lie
    in one, also into further splits.  Their ``<`` is put back; None if no record goes on.
    """
    # Any such text begins with a CDATA section in markup.
    if not in_markup(records.filter("cdata").select("id"), blocks, sections).take(1):
        return None
    marked = records.select(*BLOCK, "id", "child", "cdata")
    if sections is None:
        marked = marked.withColumn("state", F.lit(MARKUP))
    else:
        marked = blocks.dealt(marked, "id").join(blocks.dealt(sections.inside, "id"), "id", "left").fillna(MARKUP, "state")
    markup = F.col("state") == MARKUP
    goes_on = (F.col("state") == CDATA) | (markup & F.col("cdata"))
    rows = settle(marked.select(*BLOCK, "id", goes_on.alias("goes_on"), (markup & F.col("child").isNotNull()).alias("asks")))
    owner = F.when(~F.col("goes_on"), F.struct("id", "asks"))
    inside = Window.partitionBy(*BLOCK).orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    owned = blocks.dealt(rows).withColumn("owner", F.last(owner, ignorenulls=True).over(inside)).filter("goes_on").select(*BLOCK, "id", "owner")
    lasts = rows.groupBy(*BLOCK).agg(latest(F.when(~F.col("goes_on"), F.col("id")), F.col("asks"), "asks").alias("last"))
    earlier = Window.partitionBy("source_file").orderBy(*BLOCK[1:]).rowsBetween(Window.unboundedPreceding, -1)
    carried = settle(lasts.select(*BLOCK, F.last("last", ignorenulls=True).over(earlier).alias("carried")))
    owned = owned.join(carried, BLOCK).withColumn("owner", F.coalesce("owner", "carried")).filter("owner.asks")
    owned = blocks.dealt(owned.select("id", F.col("owner.id").alias("owner")), "id")
    parts = blocks.dealt(records.select("id", "split", "value"), "id").join(owned, "id")
    part = F.struct("split", "id", F.concat(F.lit("<"), "value").alias("text"))
    texts = blocks.dealt(parts, "owner").groupBy("owner").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return texts.select(F.col("owner").alias("id"), F.array_join("parts.text", "").alias("more"))
