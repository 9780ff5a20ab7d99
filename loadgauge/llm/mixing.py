"""Mix sources to target weights: hash order, distributed prefix sums, exact cuts.

Every document gets a key drawn from a hash of its id.  The rows are range-sorted by source
and key, so that a large source spreads over many tasks; each task sums its part, the sums of
the parts before it are its offset, and a document's place in its source is offset plus running
sum.  A source takes whole epochs of itself and then documents in key order up to its budget,
the last one in part.  Only columns and windows; no task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.llm.common import free_name, n_words_of, with_row_key, words_of
from loadgauge.plans.joining import join_facts, settle

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.0, most_epochs: int = MOST_EPOCHS
) -> DataFrame:
    """(source, source_size) -> the same with ``target``: one row per source.

    Sources in code point order, null last, get the weights in turn and share ``share`` of all
    sizes; a target stops at ``most_epochs`` times its source and the excess goes to the others by
    weight.  With sources ordered by limit over weight, the level after filling the sources before
    it is highest at the first source that does not fill, which gives the final level at once.
    The windows run over sources, not over rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumns(
        {
            "w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")),
            "limit": (F.col("source_size") * most_epochs).cast("double"),
        }
    )
    fill = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after)
    levels = ranked.withColumn("level", level)
    target = F.least("limit", F.col("w") * F.max("level").over(everything))
    return levels.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = 1.0,
    most_epochs: int = MOST_EPOCHS,
    seed: int = 17,
) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: one row per row of ``docs``.

    ``taken`` counts the words that the mix takes of a document, repeats included.  Null and
    empty texts have size 0 and are never taken; null is a source of its own; a null id has a key
    like any other; repeated rows are taken one by one.  An empty table gives no rows.  Other
    columns of ``docs`` do not matter.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("key")
    )
    in_order = ["source", "key", "doc_id", "size"]
    # Stored once: the parts must not change between the sums and the running sums.
    parts = settle(rows.repartitionByRange(*in_order).withColumn("part", F.spark_partition_id()))
    part_sums = parts.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part_sums.select(
        "source", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset")
    )
    sizes = part_sums.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most_epochs)
    facts = settle(join_facts(offsets, targets, ["source"]))
    running = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    placed = parts.withColumn("upto", F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)))
    placed = join_facts(placed, facts, ["source", "part"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    placed = placed.withColumn("epochs", epochs.cast("long"))
    rest = budget - F.col("epochs") * F.col("source_size")
    start = F.col("offset") + F.col("upto") - F.col("size")
    last = F.greatest(F.lit(0), F.least("size", rest - start))
    return placed.select(
        "doc_id", "size", "source", "source_size", "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, the last epoch cut in part.

    A document that the budget cuts appears once more with its first words only, up to the cut.
    Every row is a document, with or without id, repeated or not.  The columns of ``docs`` stay as
    they are.
    """
    columns, key = docs.columns, free_name(docs, "__key")
    docs = with_row_key(docs, "doc_id", key)
    plan = mix(docs, n_words_of(F.col("text")), id_col=key, **options).filter("taken > 0")
    ident, size, taken, keep = (free_name(docs, n) for n in ("__id", "__size", "__taken", "__keep"))
    plan = plan.select(F.col("doc_id").alias(ident), F.col("size").alias(size), F.col("taken").alias(taken))
    whole = F.floor(F.col(taken) / F.col(size)).cast("int")
    cut = F.col(taken) % F.col(size)
    copies = F.array_repeat(F.col(size), whole)
    copies = F.when(cut > 0, F.concat(copies, F.array(cut))).otherwise(copies)
    planned = plan.select(ident, size, F.explode(copies).alias(keep))
    joined = docs.join(planned, docs[key] == planned[ident])
    words = F.slice(words_of(F.col("text")), 1, F.col(keep).cast("int"))
    text = F.when(F.col(keep) == F.col(size), F.col("text")).otherwise(F.array_join(words, " "))
    return joined.withColumn("text", text).select(columns)
