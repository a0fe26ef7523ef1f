"""What runs report and decide: counts, resources, admission, order, labels, sections, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import closure

#: Run states after which an output can't be trusted.
COMPROMISED = ("running", "failed", "interrupted")


class UnknownLabels(LookupError):
    """Labels were asked for that no node has."""


def state_counts(nodes: DataFrame) -> DataFrame:
    """(state, n); nodes without a state aren't counted."""
    return nodes.where("state is not null").groupBy("state").agg(F.count("*").alias("n"))


def compromised(run_state: Column) -> Column:
    """Whether the last run left the output in doubt; without a state it didn't."""
    return F.coalesce(run_state.isin(*COMPROMISED), F.lit(False))


def invalidated(token: Column, recorded: Column) -> Column:
    """Whether there is a token, and it isn't the recorded one."""
    return token.isNotNull() & ~token.eqNullSafe(recorded)


def resource_usage(running: DataFrame, caps: DataFrame) -> DataFrame:
    """(resource, used, available) of each capped resource, from ``running(resource, amount)`` and ``caps(resource, cap)``."""
    used = running.groupBy("resource").agg(F.sum("amount").alias("used"))
    both = caps.join(used, "resource", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return both.select("resource", "used", (F.col("cap") - F.col("used")).alias("available"))


def admitted(ready: DataFrame, cap: int, queue: str, order: str, amount: str) -> DataFrame:
    """The rows of ``ready`` that may start, greedily in order: one that doesn't fit is passed over, the first starts in any case.

    A queue is the ready calls of a run: it is folded as one array.
    """
    calls = F.array_sort(F.collect_list(F.struct(order, amount)))
    none = F.array().cast(f"array<{dict(ready.dtypes)[order]}>")
    start = F.struct(F.lit(0).cast("long").alias("used"), none.alias("ids"))

    def step(acc: Column, call: Column) -> Column:
        fits = (acc["used"] + call[amount] <= cap) | (F.size(acc["ids"]) == 0)
        return F.when(fits, F.struct((acc["used"] + call[amount]).cast("long").alias("used"), F.array_append(acc["ids"], call[order]).alias("ids"))).otherwise(acc)

    taken = ready.groupBy(queue).agg(F.aggregate(calls, start, step, lambda acc: acc["ids"]).alias("_ids"))
    return ready.join(taken.select(queue, F.explode("_ids").alias(order)), [queue, order], "left_semi")


def schedule(ready: DataFrame, queue: str, order: str, component: str | None = None) -> DataFrame:
    """``ready`` with its place in the queue: first come first served, or, by component, those of small ones first (with ``size``)."""
    by = [order]
    if component is not None:
        ready = ready.withColumn("size", F.count("*").over(Window.partitionBy(queue, component)))
        by = ["size", order]
    return ready.withColumn("place", F.row_number().over(Window.partitionBy(queue).orderBy(*by)))


def resolve(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of ``nodes(label, ...)`` with the labels asked for; a label that no node has is an error."""
    asked = labels.select("label").distinct()
    if unknown := [r["label"] for r in asked.join(nodes, "label", "left_anti").orderBy("label").limit(20).collect()]:
        raise UnknownLabels(f"no label {', '.join(unknown)}")
    return nodes.join(asked, "label", "left_semi")


def agreed_sections(rows: DataFrame) -> DataFrame:
    """(node, section) of ``rows(node, section)``: the section if all that name the node agree (no section is a vote), else null."""
    votes = rows.groupBy("node").agg(F.min("section").alias("lo"), F.max("section").alias("hi"), F.count("section").alias("given"), F.count("*").alias("all"))
    agree = (F.col("lo") == F.col("hi")) & (F.col("given") == F.col("all"))
    return votes.select("node", F.when(agree, F.col("lo")).alias("section"))


def call_groups(nodes: DataFrame) -> DataFrame:
    """(rule, fingerprint, forced, threads, n): calls of ``nodes(rule, fingerprint, forced, threads)``."""
    return nodes.groupBy("rule", "fingerprint").agg(F.bool_or("forced").alias("forced"), F.max("threads").alias("threads"), F.count("*").alias("n"))


def call_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(child_call, parent_call): distinct edges between calls of ``nodes(key, call)``, none from a call to itself."""
    child, parent = nodes.select(F.col("key").alias("child"), F.col("call").alias("child_call")), nodes.select(F.col("key").alias("parent"), F.col("call").alias("parent_call"))
    return edges.join(child, "child").join(parent, "parent").where("child_call <> parent_call").select("child_call", "parent_call").distinct()


def inner_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges of which both ends are among ``keys(key)``."""
    return edges.join(keys.toDF("child"), "child", "left_semi").join(keys.toDF("parent"), "parent", "left_semi").select("child", "parent")


def skipped_layers(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """(child, parent, layer): a row for each layer that an edge passes, from ``levels(key, level)``."""
    low, high = levels.toDF("parent", "_low"), levels.toDF("child", "_high")
    long = edges.join(low, "parent").join(high, "child").where("_high - _low > 1")
    return long.select("child", "parent", F.explode(F.sequence(F.col("_low") + 1, F.col("_high") - 1)).alias("layer"))


def execution_summary(events: DataFrame, requested: DataFrame, edges: DataFrame) -> DataFrame:
    """Events of the requested nodes and all their ancestors, by key; nodes without an event are left out."""
    return events.join(closure(requested, edges), "key", "left_semi").orderBy("key")
