"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node reachable.

    Every round links nodes to the smallest neighbour (Kiveris et al., "Connected
    components in MapReduce and beyond"): the edge count never grows, a hub is
    never gathered in one task (minima are pre-aggregated, the join back can be
    split), and rounds grow with the logarithm of the longest path.  Nulls and
    self-loops are ignored; no edges give no rows.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        few=True,
    )
    state = _state(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small, few=True)
        now = _state(new)
        done, e, state = now == state, new, now
        if done:
            break
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    return (
        e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")))
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )
