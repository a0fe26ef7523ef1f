"""Dense ranks without gathering a group in one task.

Rows are dealt into hashed buckets, whose counts (bounded: at most ``MOST`` buckets
for each group) give every bucket its first rank; rows are ranked within a bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET, LEAST, MOST = 1000, 64, 1 << 16


def buckets(rows: int) -> int:
    """So many that a bucket has about ``ROWS_A_BUCKET`` rows, within fixed limits."""
    return max(LEAST, min(MOST, -(-rows // ROWS_A_BUCKET)))


def with_rank(df: DataFrame, group: str, order: list[str], rows: int, name: str = "rank") -> DataFrame:
    """``df`` with the rank (from 0, dense) of each row in its group; ``rows`` is about the row count.

    The order within a group is by bucket, then by ``order``; it is the same for the
    same rows.  Rows equal in ``order`` get different ranks.
    """
    n = buckets(rows)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_within", within).join(first, [group, "_bucket"]).withColumn(name, F.col("_first") + F.col("_within")).drop("_bucket", "_within", "_first")


def running_total(df: DataFrame, amount: Column) -> list[tuple[int, int]]:
    """Bucket totals of ``amount`` over ``df(_bucket, ...)``, on the driver: at most ``MOST`` rows."""
    return sorted((r["_bucket"], r["n"]) for r in df.groupBy("_bucket").agg(F.sum(amount).alias("n")).collect())
