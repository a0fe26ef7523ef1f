"""The flagship pipeline: two scans, a join, an aggregate, run through a workspace."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from .rules import ArtifactType, Node, Rule
from .workspace import Workspace

TABLE = ArtifactType("Table")
ORDERS = ArtifactType("Orders", (TABLE,), ("o_orderkey", "o_orderpriority"))
LINES = ArtifactType("Lines", (TABLE,), ("l_orderkey", "l_extendedprice", "l_discount"))
PRICED = ArtifactType("Priced", (TABLE,), ("o_orderpriority", "revenue"))


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_orderpriority")


def _lines(spark: SparkSession, folder: str, since: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").where(f"l_shipdate >= timestamp '{since}'")
    return lines.select("l_orderkey", "l_extendedprice", "l_discount")


scan_orders = Rule("scan_orders", {"folder": str}, {"orders": ORDERS}, function=_orders, version="1")
scan_lines = Rule("scan_lines", {"folder": str, "since": str}, {"lines": LINES}, function=_lines, version="1")
price = Rule(
    "price", {"orders": ORDERS, "lines": LINES}, {"priced": PRICED},
    sql="SELECT o_orderpriority, l_extendedprice * (1 - l_discount) AS revenue FROM {lines} JOIN {orders} ON l_orderkey = o_orderkey",
)
by_priority = Rule(
    "by_priority", {"priced": PRICED}, {"totals": PRICED},
    sql="SELECT o_orderpriority, round(sum(revenue), 2) AS revenue, count(*) AS n_lines FROM {priced} GROUP BY o_orderpriority",
)


def flagship_plan(spark: SparkSession, sf_dir: str, root: str, since: str = "1995-01-01 00:00:00") -> tuple[Workspace, Node]:
    """Make the totals, as far as the store hasn't them; the store and the node."""
    work = Workspace(spark, root)
    totals = by_priority(price(scan_orders(sf_dir), scan_lines(sf_dir, since)))
    work.execute([totals])
    return work, totals


def flagship(spark: SparkSession, sf_dir: str, root: str | None = None, since: str = "1995-01-01 00:00:00") -> DataFrame:
    """Revenue by order priority of lines shipped since then."""
    if root is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"{shared or tempfile.mkdtemp(prefix='loomline-')}/flagship"
    work, totals = flagship_plan(spark, sf_dir, root, since)
    return work.read(totals)
