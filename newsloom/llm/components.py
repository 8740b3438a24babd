"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import checkpointed


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (the larger ones, or itself and the smaller ones) are tied to its smallest one."""
    ends = _both(links) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = ends.join(least, "a")
    if large:
        made = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return made.where(F.col("a") != F.col("b")).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (long columns a, b): root is the smallest node that it reaches.

    Large and small stars alternate until every node hangs on its root; each round is cut off by a checkpoint. Minima
    are summed before the shuffle, and no node's neighbours are gathered. Loops and repeated links change nothing; no
    links give no rows.
    """
    state, seen = checkpointed(links.select("a", "b").where(F.col("a") != F.col("b")).distinct()), None
    while True:
        state = checkpointed(_stars(_stars(state, True), False))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen or not now[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
