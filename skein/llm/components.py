"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component. Nodes may be of any type
    that has an order.

    Each round hangs every node's larger neighbours, then its smaller ones, below the smallest of its neighbourhood,
    until nothing moves. A node's neighbours are never gathered: their minimum is aggregated and joined back. Each
    round's edges are a table in the shared folder. Edges with a null end, self-links and repeats do no harm; no edges
    give no rows.
    """
    now, state = _kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        after, new = _kept(small.select(F.col("b").alias("x"), "m").unionAll(low.select(F.col("a").alias("x"), "m")).where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct())
        discard(now)
        now = after
        if new == state:
            break
        state = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and the sum of their hashes, which tell whether a round has moved any."""
    seen = Observation()
    table = saved(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    return table, (seen.get["n"], seen.get["h"])
