"""Operators on lines and rows: what text tools do to files, with an explicit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def concatenated(frames: list[DataFrame], name: str = "part") -> DataFrame:
    """All rows, with the ordinal of the frame that a row is from (from 1)."""
    return reduce(DataFrame.unionByName, (df.withColumn(name, F.lit(k)) for k, df in enumerate(frames, 1)))


def pasted(left: DataFrame, right: DataFrame, line: str) -> DataFrame:
    """Two tables side by side by line number; where one is shorter, its text columns are empty."""
    both = left.join(right, line, "full_outer")
    texts = [c for c, kind in both.dtypes if kind == "string" and c != line]
    return both.fillna("", texts)


def adjacent_distinct(rows: DataFrame, value: str, order: list[str], within: list[str]) -> DataFrame:
    """Rows whose ``value`` differs from that of the row before; nulls are equal."""
    before = Window.partitionBy(*within).orderBy(*order)
    first = free(rows, "_first")
    same = F.col(value).eqNullSafe(F.lag(value).over(before)) & (F.row_number().over(before) > 1)
    return rows.withColumn(first, ~same).where(first).drop(first)


def placed(rows: DataFrame, order: list[str], within: list[str], name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in ``order`` within their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def head(rows: DataFrame, n: int, order: list[str | Column]) -> DataFrame:
    """The first ``n`` rows in ``order``: a top-k, not a sort."""
    return rows.orderBy(*order).limit(n)


def tee(rows: DataFrame, paths: list[str]) -> DataFrame:
    """Write the rows to the first path, and what was written to the others."""
    rows.write.mode("overwrite").parquet(paths[0])
    written = rows.sparkSession.read.parquet(paths[0])
    for path in paths[1:]:
        written.write.mode("overwrite").parquet(path)
    return written


def repeated(rows: DataFrame, times: Column, name: str) -> DataFrame:
    """Each row as often as ``times`` says, numbered from 1 in ``name``; zero, a negative number and null give none."""
    return rows.withColumn(name, F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times.cast("long")))))


def overlaid(base: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): entries of ``base``, those of ``patch`` in their place or added."""
    given = patch.select(F.col(key), F.struct(F.col(value).alias("v")).alias("_patch"))
    both = base.select(key, F.col(value).alias("_base")).join(given, key, "full_outer")
    return both.select(key, F.when(F.col("_patch").isNotNull(), F.col("_patch")["v"]).otherwise(F.col("_base")).alias(value))


def distinct_in_order(rows: DataFrame, value: str, order: str, within: str, name: str) -> DataFrame:
    """(within, name): the distinct values of a group, comma-joined, by first appearance; as many as there are kinds of values."""
    first = rows.groupBy(within, value).agg(F.min(order).alias("_at"))
    kept = F.array_sort(F.collect_list(F.struct("_at", value)))
    return first.groupBy(within).agg(F.array_join(F.transform(kept, lambda x: x[value]), ",").alias(name))


def top_by_sum(rows: DataFrame, array: str, k: int, ties: str, name: str = "total") -> DataFrame:
    """The ``k`` rows with the largest array sums (0 for an empty one), with ``name``; ties in the order of ``ties``."""
    total = F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return head(rows.withColumn(name, total), k, [F.desc(name), ties])


def newest(files: DataFrame, call: str, modified: str, name: str = "mtime") -> DataFrame:
    """(call, mtime): when the newest file of an output was changed."""
    return files.groupBy(call).agg(F.max(modified).alias(name))


def output_sizes(files: DataFrame, call: str, path: str, length: str, name: str = "size") -> DataFrame:
    """(call, size): bytes of the files of a call, without what stands in folders or files whose names start with an underscore or a point."""
    return files.where(~F.col(path).rlike(r"(^|/)[._]")).groupBy(call).agg(F.sum(length).alias(name))


def directory_digests(files: DataFrame, folder: str, path: str, digest: str, name: str = "digest") -> DataFrame:
    """(folder, digest): over the sorted (path, digest) of its files, without metadata; a hash of hashes, as content needn't be gathered."""
    own = files.where(~F.col(path).rlike(r"(^|/)[._]"))
    listed = F.array_sort(F.collect_list(F.concat_ws("\0", path, digest)))
    return own.groupBy(folder).agg(F.sha2(F.array_join(listed, "\0"), 256).alias(name))


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
