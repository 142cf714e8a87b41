"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, stash


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (one node of it) of every node that a link (x, y) names.

    In each round a vertex merges into its smallest neighbour or stays, and the
    links between merged vertices form the next, smaller graph. With ids that are
    hashes the number of rounds grows with the logarithm of the number of nodes.
    Nothing but a count reaches the driver, and the tables of a round are deleted
    after the next. The result is a table of its own.
    """
    flipped = links.select(F.col("y").alias("x"), F.col("x").alias("y"))
    both = stash(links.select("x", "y").unionByName(flipped).filter("x <> y").distinct())
    found = stash(both.select(F.col("x").alias("node"), F.col("x").alias("component")).distinct())
    while both.limit(1).count():
        parent = stash(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("parent")))
        left = both.join(parent, "x").select(F.col("parent").alias("x"), "y")
        moved = left.join(parent.select(F.col("x").alias("y"), F.col("parent").alias("z")), "y").select("x", F.col("z").alias("y"))
        rest = stash(moved.filter("x <> y").distinct())
        step = parent.select(F.col("x").alias("component"), "parent")
        next_ = stash(found.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")))
        for old in (both, parent, found):
            discard(old)
        both, found = rest, next_
    discard(both)
    return found


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` after further links: only links between different components enter the contraction."""
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    named = links.join(of("x"), "x", "left").join(of("y"), "y", "left")
    across = named.select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y")).filter("x <> y").distinct()
    step = components(across)
    moved = groups.join(step.select(F.col("node").alias("component"), F.col("component").alias("_next")), "component", "left")
    fresh = step.join(groups.select("node"), "node", "left_anti").select("node", "component")
    return stash(moved.select("node", F.coalesce("_next", "component").alias("component")).unionByName(fresh))
