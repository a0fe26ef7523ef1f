"""Parameter grids: every key that ends in ``__grid`` is an axis, the first one slowest."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUFFIX, LABEL = "__grid", "__label"


def axes(config: dict, at: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], list]]:
    """(path, values) of each axis, in document order; tables are searched.  A table on an axis that has a grid itself counts as all its configs."""
    out = []
    for k, v in config.items():
        if k.endswith(SUFFIX):
            if not isinstance(v, list) or not v:
                raise ValueError(f"{'.'.join((*at, k))} isn't a list with values")
            out.append(((*at, k[: -len(SUFFIX)]), [c for x in v for c in (expand(x) if isinstance(x, dict) else (x,))]))
        elif isinstance(v, dict):
            out += axes(v, (*at, k))
    return out


def _plain(table: dict) -> dict:
    return {k: _plain(v) if isinstance(v, dict) else v for k, v in table.items() if not k.endswith(SUFFIX)}


def assemble(config: dict, found: list[tuple[tuple[str, ...], list]], at: tuple[int, ...]) -> dict:
    """The config at one position of each axis; labels of tables are for names only and left out."""
    out = _plain(config)
    for (path, values), k in zip(found, at, strict=True):
        place = reduce(lambda t, name: t.setdefault(name, {}), path[:-1], out)
        value = values[k]
        place[path[-1]] = {n: x for n, x in value.items() if n != LABEL} if isinstance(value, dict) else value
    return out


def expand(config: dict) -> Iterator[dict]:
    """The configs of a grid; one if there is no axis."""
    found = axes(config)
    for at in product(*(range(len(v)) for _, v in found)):
        yield assemble(config, found, at)


def cross(frames: list[DataFrame]) -> DataFrame:
    """Cartesian product of axis tables (each of a few rows, by definition of a grid)."""
    return reduce(lambda a, b: a.crossJoin(b), frames)


def expand_rows(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """Rows with every combination of the values of their own array columns: a grid inside each row."""
    return reduce(lambda df, name: df.withColumn(name, F.explode(name)), arrays, rows)


def auto_label(cells: DataFrame) -> DataFrame:
    """(axis, label_key) of ``cells(axis, element, key, value)``: the first key with a distinct value for each element of its axis.

    Null where no key will do; then the index names an element.
    """
    size = cells.groupBy("axis").agg(F.countDistinct("element").alias("n"))
    per = cells.groupBy("axis", "key").agg(F.count("value").alias("present"), F.countDistinct("value").alias("distinct"))
    fits = per.join(size, "axis").groupBy("axis")
    return fits.agg(F.min(F.when((F.col("present") == F.col("n")) & (F.col("distinct") == F.col("n")), F.col("key"))).alias("label_key"))
