"""Connected components by alternating large-star and small-star rounds, each a grouping and a join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.tables import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 100, keep: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, component) for the nodes of edges (u, v), but for each component's least node, which is its name.

    Nodes may be of any ordered type. The number of rounds grows with the
    logarithm of the largest component; if the given number isn't enough this
    is an error. Each round's edges are written by keep. Loops and repeated
    edges don't matter; no edges give no rows.
    """
    edges = keep(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are dealt anew and a hub's rows can be split
        least = keep(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = keep(large.where(F.col("u") != F.col("v")).distinct(), "large-star")
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = keep(small.where(F.col("u") != F.col("v")).distinct(), "small-star")
        now = _state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components are not final after {rounds} rounds")
