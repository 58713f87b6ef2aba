"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node's larger (or smaller) neighbours are tied to its smallest one instead."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    tied = both.join(least, "a").select("a", "b", F.least("a", "m").alias("m"))
    if small:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        out = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the smallest node reachable.

    Nulls and self-loops are left out, repeated edges count once, no edges give no rows. Each round is
    written to the shared folder; hub nodes are only met in sums and in joins, which Spark can split."""
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        after = durable(_star(_star(edges, False), True), "edges")
        drop(edges)
        edges = after
        now = tuple(edges.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38, 0)))")).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
