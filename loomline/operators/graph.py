"""Graph operators over ``edges(child, parent)``: frontier loops with reliable checkpoints.

A loop computes its edges once and writes one small checkpoint a round, from which it
also learns whether to go on; depth, not size, sets the number of rounds.  A graph of
thousands of nodes is quicker on the driver (``loomline.plans``); these serve queries
and very large graphs.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds whose results are kept side by side before they are written as one.
ROUNDS_APART = 8


def _cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, with one file for eight shuffle partitions or one for each core."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="loomline-"))
    return df.coalesce(max(sc.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)).checkpoint(eager=True)


def sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are no one's parent."""
    return nodes.join(edges.select(F.col("parent").alias("key")), "key", "left_anti")


def closure(start: DataFrame, edges: DataFrame) -> DataFrame:
    """``start(key)`` and all ancestors."""
    edges = _cut(edges.select("child", "parent"))
    frontier = _cut(start.select("key").distinct())
    rounds = [frontier]
    while True:
        seen = reduce(DataFrame.union, rounds)
        reached = edges.join(frontier, edges["child"] == frontier["key"]).select(F.col("parent").alias("key")).distinct()
        frontier = _cut(reached.join(seen, "key", "left_anti"))
        if not frontier.count():
            return seen if len(rounds) == 1 else _cut(seen)
        rounds.append(frontier)
        if len(rounds) > ROUNDS_APART:
            rounds = [_cut(reduce(DataFrame.union, rounds))]


def descendants(start: DataFrame, edges: DataFrame) -> DataFrame:
    """``start(key)`` and all descendants: what staleness spreads to."""
    return closure(start, edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, level): longest distance from a source.  A cycle is an error.

    Each round takes off the nodes that have no parent left; a round that takes off
    none has met a cycle.
    """
    left = _cut(nodes.select("key").distinct())
    keys = left
    edges = _cut(edges.select("child", "parent").join(keys.toDF("parent"), "parent", "left_semi").where("child <> parent").unionByName(edges.where("child = parent").select("child", "parent")))
    n, level, rounds = left.count(), 0, []
    while n:
        held = edges.join(left, edges["parent"] == left["key"], "left_semi").select(F.col("child").alias("key")).distinct().withColumn("held", F.lit(True))
        split = _cut(left.join(held, "key", "left"))
        rounds.append(split.where("held is null").select("key", F.lit(level).alias("level")))
        left = split.where("held").select("key")
        before, n = n, left.count()
        if n == before:
            raise ValueError("the graph has a cycle")
        level += 1
        if len(rounds) > ROUNDS_APART:
            rounds = [_cut(reduce(DataFrame.union, rounds))]
    return _cut(reduce(DataFrame.union, rounds)) if rounds else keys.select("key", F.lit(0).alias("level"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, component): the smallest key reachable, edges taken both ways."""
    edges = _cut(edges.select("child", "parent"))
    both = edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(edges.select(F.col("parent").alias("a"), F.col("child").alias("b")))
    label = _cut(nodes.select("key", F.col("key").alias("component")))
    while True:
        near = both.join(label, both["b"] == label["key"]).groupBy(F.col("a").alias("key")).agg(F.min("component").alias("near"))
        step = label.join(near, "key", "left").select("key", F.least("component", F.coalesce("near", "component")).alias("to"), F.col("component").alias("was"))
        jump = step.join(step.select(F.col("key").alias("to"), F.col("to").alias("on")), "to", "left").select("key", F.least("to", F.coalesce("on", "to")).alias("component"), "was")
        new = _cut(jump)
        label = new.select("key", "component")
        if new.where("component < was").isEmpty():
            return label


def classify(nodes: DataFrame, edges: DataFrame, required: DataFrame) -> DataFrame:
    """(key, state) of ``nodes(key, exists, mtime, changed, token_changed)``.

    Outside the closure: ORPHAN if it exists, else null.  Inside: MISSING if it doesn't
    exist; STALE if a parent is newer with changed content, the token has changed, or
    any ancestor inside is MISSING or STALE; else UP_TO_DATE.
    """
    edges = _cut(edges.select("child", "parent"))
    active = closure(required, edges)
    inside = nodes.join(active, "key", "left_semi")
    within = _cut(edges.join(active.toDF("child"), "child", "left_semi"))
    parent = inside.select(F.col("key").alias("parent"), F.col("mtime").alias("p_mtime"), F.col("changed").alias("p_changed"))
    own = inside.select(F.col("key").alias("child"), "mtime")
    newer = within.join(own, "child").join(parent, "parent").where((F.col("p_mtime") > F.col("mtime")) & F.col("p_changed")).select(F.col("child").alias("key"))
    seed = inside.where(~F.col("exists") | F.col("token_changed")).select("key").unionByName(newer)
    stale = descendants(seed, within)
    # A node is in neither, one or both: one aggregate instead of two joins.
    marks = active.select("key", F.lit(1).alias("mark")).unionByName(stale.select("key", F.lit(2).alias("mark")))
    marked = _cut(marks.groupBy("key").agg(F.sum("mark").alias("mark")))
    state = (
        F.when(F.col("mark").isNull(), F.when(F.col("exists"), F.lit("ORPHAN")))
        .when(~F.col("exists"), F.lit("MISSING"))
        .when(F.col("mark") == 3, F.lit("STALE"))
        .otherwise(F.lit("UP_TO_DATE"))
    )
    return nodes.join(marked, "key", "left").select("key", state.alias("state"))


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the first in ``order``; pre-aggregated, so that a frequent key is no hot task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(key, "_r.*")


def accumulate(settings: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, name, value): ``settings(key, name, value)`` of each node and its ancestors, merged.

    A node's own value wins over its parents', a parent of a later ``position`` in
    ``edges(child, parent, position)`` over an earlier one.
    """
    own = settings.select("key", "name", "value")

    def fold(done: DataFrame, level: DataFrame) -> DataFrame:
        given = level.join(done.withColumnRenamed("key", "parent"), "parent")
        taken = given.groupBy(F.col("child").alias("key"), "name").agg(F.max_by("value", "position").alias("value"))
        return taken.join(own, ["key", "name"], "left_anti").unionByName(own.join(level.select(F.col("child").alias("key")).distinct(), "key", "left_semi"))

    return _by_level(own, edges, nodes, fold)


def fingerprints(nodes: DataFrame, edges: DataFrame, recipe: str = "recipe") -> DataFrame:
    """(key, fingerprint): 16 hex digits over a node's recipe and the fingerprints of its parents by ``position``.

    The parents of one node are as many as its rule has inputs.
    """
    own = nodes.select("key", F.col(recipe).alias("_r"))
    digest = lambda text: F.substring(F.sha2(text, 256), 1, 16).alias("fingerprint")

    def fold(done: DataFrame, level: DataFrame) -> DataFrame:
        given = level.join(done.withColumnRenamed("key", "parent"), "parent").groupBy(F.col("child").alias("key"))
        parents = given.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "fingerprint"))), lambda p: p["fingerprint"]), "|").alias("_p"))
        return own.join(parents, "key").select("key", digest(F.concat_ws("|", "_r", "_p")))

    return _by_level(own.select("key", digest(F.col("_r"))), edges, nodes, fold)


def _by_level(start: DataFrame, edges: DataFrame, nodes: DataFrame, fold) -> DataFrame:
    """Fold from the sources on: rows of ``start`` for these, ``fold(rows of lower levels, edges of the level)`` for the others."""
    level = levels(nodes, edges.select("child", "parent"))
    deep = _cut(edges.join(level.withColumnRenamed("key", "child"), "child"))
    done = _cut(start.join(level.where("level = 0").select("key"), "key", "left_semi"))
    for k in range(1, (level.agg(F.max("level")).first()[0] or 0) + 1):
        done = _cut(done.unionByName(fold(done, deep.where(F.col("level") == k).drop("level"))))
    return done
