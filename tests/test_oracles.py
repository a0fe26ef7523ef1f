"""Every query with oracle SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from loomline.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def _rows(names, rows):
    """Rows as a bag, columns by name."""
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(names), Counter(repr(tuple(float(r[k]) if isinstance(r[k], float) else r[k] for k in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    wanted = duck.execute(ORACLES[name])
    names = [d[0] for d in wanted.description]
    assert _rows(found.columns, [tuple(r) for r in found.collect()]) == _rows(names, wanted.fetchall())
