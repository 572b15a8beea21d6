"""Connected components by alternating large and small stars, checkpointed each round."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FREQUENT, MOST_FREQUENT, materialize, remove


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """``rows`` joined by a with the least neighbours.  A merge join would deal all edges of a hub to one
    task, so nodes with over ``FREQUENT`` neighbours are broadcast while they are few: there are twice the
    edges divided by that at most, and where this says too little they are counted."""
    if n_edges <= FREQUENT:
        return rows.join(least, "a")
    hubs = least.where(F.col("k") > FREQUENT)
    if 2 * n_edges > FREQUENT * MOST_FREQUENT and hubs.count() > MOST_FREQUENT:
        return rows.join(least, "a")
    rest = rows.join(F.broadcast(hubs.select("a")), "a", "left_anti").join(least.where(F.col("k") <= FREQUENT), "a")
    return rest.unionByName(rows.join(F.broadcast(hubs), "a"))


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root) of every node with an edge but the roots; ``edges`` has long columns a and b.

    The root is the least node of its component.  Each round hands every neighbour list on by its
    minimum alone, so a hub costs one combined row for each task, and hubs are looked up in a broadcast
    table.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, f"{path}/round0")
    before = _fingerprint(edges)
    for k in itertools.count(1):  # the logarithm of the longest path, squared, at most
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k")).select("a", F.least("a", "m").alias("m"), "k")
        large = _with_least(both.where("b > a"), least, before[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/round{k}")
        now = _fingerprint(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        remove(edges.sparkSession, f"{path}/round{k - 1}")
        before = now
