from __future__ import annotations

import pytest

from loomline.plans.flagship import LINES, flagship, price, scan_lines, scan_orders
from loomline.plans.grid import expand
from loomline.plans.rules import ArtifactType, ContractError, Rule
from loomline.plans.workspace import Workspace

T = ArtifactType("T", (), ("x",))
SUB = ArtifactType("Sub", (T,))
OTHER = ArtifactType("Other")


def _numbers(spark, n):
    return spark.range(n).selectExpr("id AS x")


def _fails(spark):
    raise RuntimeError("no")


numbers = Rule("numbers", {"n": int}, {"out": SUB}, function=_numbers, version="1")
double = Rule("double", {"t": T}, {"out": T}, sql="SELECT 2 * x AS x FROM {t}")
broken = Rule("broken", {}, {"out": T}, function=_fails)
add = Rule("add", {"a": T, "b": T}, {"out": T}, sql="SELECT x FROM {a} UNION ALL SELECT x FROM {b}")


def test_contracts():
    with pytest.raises(ContractError):
        numbers("3")
    with pytest.raises(ContractError):
        numbers()
    with pytest.raises(ContractError):
        Rule("bad", {"t": T}, {"out": T}, sql="SELECT * FROM {u}")
    with pytest.raises(ContractError):
        price(scan_lines("d", "1995-01-01"), scan_orders("d"))
    assert SUB.is_a(T) and not T.is_a(SUB) and not LINES.is_a(OTHER)


def test_fingerprints_follow_the_lineage():
    assert double(numbers(3)).key == double(numbers(3)).key
    assert double(numbers(3)).key != double(numbers(4)).key
    assert double(double(numbers(3))).key != double(numbers(3)).key


def test_second_run_does_nothing(spark, tmp_path):
    work = Workspace(spark, str(tmp_path))
    wanted = double(numbers(3))
    assert [e.state for e in work.execute([wanted])] == ["DONE", "DONE"]
    assert sorted(r.x for r in work.read(wanted).collect()) == [0, 2, 4]
    assert [e.state for e in work.execute([wanted])] == ["UP_TO_DATE", "UP_TO_DATE"]
    assert [s for _, s in work.plan([wanted], force=("numbers",))] == ["STALE", "STALE"]
    assert [s for _, s in work.plan([double(numbers(3)), double(numbers(5))])] == ["UP_TO_DATE", "UP_TO_DATE", "MISSING", "MISSING"]


def test_keep_going(spark, tmp_path):
    work = Workspace(spark, str(tmp_path))
    events = work.execute([add(broken(), numbers(1)), double(numbers(2))], keep_going=True)
    assert {e.rule: e.state for e in events} == {"broken": "FAILED", "numbers": "DONE", "add": "BLOCKED", "double": "DONE"}
    with pytest.raises(RuntimeError):
        work.execute([broken()])


def test_grid():
    configs = list(expand({"a__grid": [1, 2], "t": {"b__grid": ["x", "y"], "c": 3}}))
    assert configs == [{"a": a, "t": {"b": b, "c": 3}} for a in (1, 2) for b in ("x", "y")]
    assert list(expand({"a": 1})) == [{"a": 1}]
    with pytest.raises(ValueError, match="list"):
        list(expand({"a__grid": 3}))


def test_flagship(spark, tmp_path):
    assert flagship(spark, "/root/testdata/sf0.001", str(tmp_path)).count() == 5
