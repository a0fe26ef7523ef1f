"""States of nodes: promotion, reasons, cleanup, manifests and summaries.

``nodes(key, call, state, ...)``, ``edges(child, parent)``.  All are aggregates and
equi-joins; only ``force_stale`` loops, along the depth of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import descendants

BLOCKING = ("FAILED", "INTERRUPTED")


def promote(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, state) where nodes that wait (STALE, MISSING) become FAILED above a blocked parent, or READY above finished ones.

    Parents outside ``nodes`` don't count; a node without parents is READY.
    """
    parents = nodes.select(F.col("key").alias("parent"), F.col("state").alias("p_state"))
    over = edges.join(parents, "parent").groupBy(F.col("child").alias("key")).agg(
        F.bool_or(F.col("p_state").isin(*BLOCKING)).alias("blocked"), F.bool_and(F.col("p_state") == "UP_TO_DATE").alias("ready")
    )
    waits = F.col("state").isin("STALE", "MISSING")
    state = (
        F.when(waits & F.coalesce("blocked", F.lit(False)), F.lit("FAILED"))
        .when(waits & F.coalesce("ready", F.lit(True)), F.lit("READY"))
        .otherwise(F.col("state"))
    )
    return nodes.join(over, "key", "left").select("key", state.alias("state"))


def force_stale(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, state) after ``wanted(key)`` is invalidated: those UP_TO_DATE and all that is built from them become STALE."""
    seed = nodes.where("state = 'UP_TO_DATE'").join(wanted, "key", "left_semi")
    hit = descendants(seed, edges).withColumn("hit", F.lit(True))
    state = F.when(F.col("hit") & (F.col("state") == "UP_TO_DATE"), F.lit("STALE")).otherwise(F.col("state"))
    return nodes.join(hit, "key", "left").select("key", state.alias("state"))


def reasons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, reason): why each node of ``nodes(key, state, exists, token_changed, mtime, changed)`` has its state; one row for each reason."""
    parents = nodes.select(F.col("key").alias("parent"), F.col("state").alias("p_state"), F.col("mtime").alias("p_mtime"), F.col("changed").alias("p_changed"))
    own = nodes.select(F.col("key").alias("child"), "mtime")
    over = edges.join(parents, "parent").join(own, "child").groupBy(F.col("child").alias("key")).agg(
        F.bool_or(F.col("p_state").isin(*BLOCKING)).alias("blocked"),
        F.bool_or(F.col("p_state").isin("STALE", "MISSING")).alias("waits"),
        F.bool_or((F.col("p_mtime") > F.col("mtime")) & F.col("p_changed")).alias("content"),
    )
    found = {
        "output_missing": ~F.col("exists"),
        "blocked_by_failed_parent": F.col("blocked"),
        "compromised_prior_state": F.col("state").isin("FAILED", "INTERRUPTED", "RUNNING"),
        "invalidator_changed": F.col("token_changed"),
        "parent_not_up_to_date": F.col("waits"),
        "parent_content_changed": F.col("content"),
    }
    some = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in found.items())), lambda x: x.isNotNull())
    fallback = F.array(F.when(F.col("state") == "UP_TO_DATE", F.lit("up_to_date")).otherwise(F.lit("stale")))
    listed = nodes.join(over, "key", "left").select("key", some.alias("some"), fallback.alias("fallback"))
    return listed.select("key", F.explode(F.when(F.size("some") > 0, F.col("some")).otherwise(F.col("fallback"))).alias("reason"))


def orphan_actions(nodes: DataFrame) -> DataFrame:
    """(key, action) for orphans: ``remove_call`` if nothing else of the call is active, else ``remove_output``."""
    active = nodes.where("state <> 'ORPHAN'").select("call").distinct().withColumn("active", F.lit(True))
    found = nodes.where("state = 'ORPHAN'").join(active, "call", "left")
    return found.select("key", F.when(F.col("active"), F.lit("remove_output")).otherwise(F.lit("remove_call")).alias("action"))


def removable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(call) whose outputs all have children, every one of them UP_TO_DATE: intermediates that may go."""
    states = nodes.select(F.col("key").alias("child"), F.col("state").alias("c_state"))
    below = edges.join(states, "child").groupBy(F.col("parent").alias("key")).agg(F.bool_and(F.col("c_state") == "UP_TO_DATE").alias("done"))
    outputs = nodes.join(below, "key", "left").groupBy("call").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("free"))
    return outputs.where("free").select("call")


def type_violations(given: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of ``given(actual, expected, ...)`` whose pair isn't in ``allowed(actual, expected)``, the closed subtype relation."""
    return given.join(allowed, ["actual", "expected"], "left_anti")


def manifest(required: DataFrame, store: DataFrame) -> DataFrame:
    """Requested outputs that exist: ``required(key, ...)`` kept where ``store(key)`` has them."""
    return required.join(store.select("key"), "key", "left_semi")
