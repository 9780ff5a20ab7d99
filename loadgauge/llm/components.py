"""Connected components by hooking and contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadgauge.plans.joining import settle


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, component_id): the smallest id that each linked id can reach.

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots by
    pointer doubling, and goes on with the links between roots.  A round leaves at most the local
    minima, so the rounds are few.  Tables between rounds are written to the shared folder; only
    emptiness is asked by the driver.  Ids that occur in no link are not returned.
    """
    links = settle(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while links.take(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
        hooks = settle(hooks.select("id", F.least("id", "root").alias("root")))
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = settle(hooks.join(up, "root").select("id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            hooks = jumped.drop("moved")
            if not jumped.filter("moved").take(1):
                break
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("id").alias("root"), F.col("root").alias("next"))
            labels = settle(
                labels.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"))
            )
        a = hooks.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        b = hooks.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rooted = links.join(a, "a").join(b, "b").filter("ra <> rb")
        links = settle(rooted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return labels.withColumnRenamed("root", "component_id")
