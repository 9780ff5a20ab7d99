"""Top-k and fixed-size sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.model import RUN_KEYS, run_keys
from loadgauge.plans.histogram import histogram, needs_samples, row_count
from loadgauge.plans.joining import join_facts, settle

SAMPLE_SEED, TRIM_SEED = 42, 43
SCATTER_LIMIT, STATUS_LIMIT = 5000, 50_000


def slowest(samples: DataFrame, n: int = 20, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The n slowest samples of each run (ties: earlier, then by label), with their place.

    The histogram of a run tells from which response time on its n slowest begin; just
    the samples from there on are sorted, and only n per run and task are shuffled.
    """
    by = run_keys(keys)
    needs_samples(samples)
    down = Window.partitionBy(*by).orderBy(F.desc_nulls_last("elapsed"))
    reached = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))
    cuts = (
        histogram(samples, by)
        .withColumn("reached", reached)
        .groupBy(*by)
        .agg(F.max(F.when(F.col("reached") >= n, F.col("elapsed"))).alias("cut"))
    )
    near = join_facts(samples, settle(cuts), by).filter("cut IS NULL OR elapsed >= cut")
    order = [F.desc_nulls_last("elapsed"), "timestamp_ms", "label", "response_code", "url"]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return near.withColumn("place", place).filter(F.col("place") <= n).drop("cut")


def top_labels(samples: DataFrame, n: int = 12, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """keys, label, rows of the n labels with most samples (ties by label)."""
    by = run_keys(keys)
    counts = samples.groupBy(*by, "label").agg(row_count(samples).alias("rows"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("rows"), "label"))
    return counts.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def stratified_sample(
    samples: DataFrame,
    limit: int = SCATTER_LIMIT,
    columns: Sequence[str] = ("timestamp_ms", "elapsed"),
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """About ``limit`` rows per run, shared out over the labels, at least one for each.

    keys, label, columns..., total_rows.  A run of up to ``limit`` rows is kept whole.  With more
    labels than ``limit``, only ``limit`` of them can have a row, chosen by hash.
    """
    by = run_keys(keys)
    share = F.greatest(F.lit(1), F.bround(limit * F.col("size") / F.col("total_rows")))
    quota = F.when(F.col("total_rows") <= limit, F.col("size")).otherwise(
        F.least("size", share.cast("bigint"))
    )
    picked = _lowest_hashes(samples, [*by, "label"], by, [*by, "label", *columns], quota)
    # Rounding may have given out a few rows too many.
    kept = [c for c in picked.columns if c != "copy"]
    shuffled = F.xxhash64(*kept, "copy", F.lit(TRIM_SEED))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(shuffled, *kept, "copy"))
    return picked.withColumn("place", place).filter(F.col("place") <= limit).select(*kept)


def uniform_sample(
    samples: DataFrame,
    n: int = STATUS_LIMIT,
    columns: Sequence[str] = ("timestamp_ms", "elapsed"),
    keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """Exactly n rows per run (all, if it has fewer): keys, columns..., total_rows."""
    by = run_keys(keys)
    quota = F.least("size", F.lit(n).cast("bigint"))
    return _lowest_hashes(samples, by, by, [*by, *columns], quota).drop("copy")


def _lowest_hashes(
    samples: DataFrame, strata: list[str], run: list[str], columns: list[str], quota: Column
) -> DataFrame:
    """The ``quota`` rows of each stratum with the lowest hash of their content.

    A first pass counts the rows of a stratum by magnitude (log2) of their hash, at most
    64 counts, and finds the magnitude at which the quota is met.  The second pass keeps
    only rows up to it, about twice the quota, so no stratum is sorted or shuffled whole.
    Equal rows travel as one row with its number of copies.  As the hash depends on
    nothing but content, a repeated task chooses the same rows.
    """
    needs_samples(samples)
    content = list(dict.fromkeys(columns))
    hashed = samples.select(
        *content,
        F.shiftrightunsigned(F.xxhash64(*content, F.lit(SAMPLE_SEED)), 1).alias("hash"),
    ).withColumn("magnitude", F.floor(F.log2(F.col("hash") + F.lit(1.0))))

    stratum = Window.partitionBy(*strata)
    reached = stratum.orderBy("magnitude").rowsBetween(Window.unboundedPreceding, 0)
    sizes = hashed.groupBy(*strata, "magnitude").agg(F.count(F.lit(1)).alias("rows"))
    cuts = (
        sizes.withColumns(
            {
                "total_rows": F.sum("rows").over(Window.partitionBy(*run)),
                "size": F.sum("rows").over(stratum),
                "upto": F.sum("rows").over(reached),
            }
        )
        .withColumn("quota", quota)
        .filter(F.col("upto") >= F.col("quota"))
        .groupBy(*strata, "total_rows", "quota")
        .agg(F.min("magnitude").alias("cut"))
    )
    near = join_facts(hashed, settle(cuts), strata).filter(F.col("magnitude") <= F.col("cut"))
    counted = near.groupBy(*content, "hash", "total_rows", "quota").agg(
        F.count(F.lit(1)).alias("copies")
    )
    order = stratum.orderBy("hash", *content).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("copies").over(order) - F.col("copies")
    taken = F.least(F.col("copies"), F.col("quota") - F.col("before"))
    return (
        counted.withColumn("before", before)
        .filter(F.col("before") < F.col("quota"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), taken.cast("int"))))
        .select(*content, "total_rows", "copy")
    )
