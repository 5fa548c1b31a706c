"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(links: DataFrame, both: bool) -> DataFrame:
    """Each node's neighbours (both: larger ones, else those not larger, and the node) are tied to the smallest of all."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    rows = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = rows.join(least, "u")
    if both:
        return tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    return tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """links: (a, b) of one orderable type (longs are aggregated by hash, strings by sorting).  Returns (node, root): the smallest node that each linked node reaches.

    Nodes without a link to another are not returned.  The links stay distributed; each round is written to the
    checkpoint folder, and a count and a hash of the links tell when nothing changes any more.
    """
    state = materialise(links.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first())
    before = sign(state)
    for _ in range(most_rounds):
        if before[0] == 0:
            break
        state = materialise(_star(_star(state, True), False))
        after = sign(state)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = state.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
