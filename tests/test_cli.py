from __future__ import annotations

import json
import threading
import tomllib

import pytest

from loomline import cli
from loomline.plans import config as C
from loomline.plans.grid import expand
from loomline.plans.labels import join_label, labeller, table_tokens, token_diff, value_token
from loomline.plans.pipeline import Pipeline
from loomline.plans.rules import ArtifactType, ContractError, Rule
from loomline.plans.workspace import StoreLocked, Workspace

T = ArtifactType("T")
number = Rule("number", {"n": int}, {"out": T}, sql="SELECT {n} AS x")
pair = Rule("pair", {"a": T, "b": T}, {"out": T}, sql="SELECT x FROM {a} UNION ALL SELECT x FROM {b}")


def test_tokens():
    assert value_token(-1.5) == "neg1p5" and value_token(True) == "true" and value_token("a b/[c],.x") == "ab_c-px"
    assert token_diff("run fast now", "run very slow now") == "very_slow" and value_token("x y", "x z") == "y"
    assert table_tokens([{"b": "p", "a": "q"}, {"b": "r", "a": "q"}]) == ["p", "r"]
    assert table_tokens([{"a": 1}, {"a": 2}]) == ["0", "1"]
    assert table_tokens([{"a": 1, "__label": "x y"}, {"a": 2}]) == ["xy", "1"]


def test_labels():
    found = [(("t", "a"), ["x", "y"]), (("n",), [1, 2])]
    assert labeller("job", found)((1, 0)) == "job__t_a+y__n+1"
    assert labeller("job", found, short=True)((1, 0)) == "job__y__n+1"
    long = join_label("job", [("a", "é" * 200)])
    assert len(long.encode()) <= 250 and long[-9] == "_"


def test_grid_within_a_table():
    configs = list(expand({"m__grid": [{"k": "a", "n__grid": [1, 2]}, {"k": "b", "__label": "last"}]}))
    assert configs == [{"m": {"k": "a", "n": 1}}, {"m": {"k": "a", "n": 2}}, {"m": {"k": "b"}}]


def test_fields(tmp_path):
    assert C.set_field({"a": {"b": 1}}, "a..c", 2) == {"a": {"b": 1, "c": 2}}
    with pytest.raises(C.ConfigError):
        C.set_field({"a": 1}, "a.b", 2)
    with pytest.raises(C.ConfigError):
        C.field_path("..")
    C.write_config(tmp_path / "a.toml", {"x": [1, 2.5], "t": {"k": 'q"'}, "none": None})
    C.write_config(tmp_path / "b.toml", {"v": {"w": True}})
    assert cli.main(["set-field", str(tmp_path / "a.toml"), str(tmp_path / "c.toml"), "t.n", str(tmp_path / "b.toml"), "v.w"]) == 0
    assert C.read_config(tmp_path / "c.toml") == {"x": [1, 2.5], "t": {"k": 'q"', "n": True}}
    with pytest.raises(C.ConfigError):
        C.read_config(tmp_path / "a.yaml")


def test_label_sets(tmp_path):
    (tmp_path / "r.toml").write_text('a = ["x", "y"]\nb = ["y"]\nc = 3\n')
    assert C.label_sets(tmp_path / "r.toml", ["a", "b"]) == ("x", "y")
    for path, name in (("r.toml", "c"), ("r.toml", "d"), ("s.toml", "a")):
        with pytest.raises(C.ConfigError):
            C.label_sets(tmp_path / path, [name])


def test_pipeline_labels():
    p = Pipeline()
    with p.section("first"):
        p.a = number(1)
    p.b = pair(p.a, number(2))
    assert list(p.sinks()) == ["b"] and p.section_of("a") == "first" and p.section_of("b") is None
    for label, node in (("a", number(3)), (".x", number(3)), ("y", 3)):
        with pytest.raises(ContractError):
            p.add(label, node)
    with pytest.raises(ContractError):
        p.requested(("z",))


def test_caps():
    assert cli.caps("4", ["ram=2Ki", "threads=3"]) == {"threads": 3, "ram": 2048}
    with pytest.raises(C.ConfigError):
        cli.caps("4", ["ram"])
    with pytest.raises(C.ConfigError):
        cli.amount("2x")


def test_calls_run_side_by_side_and_the_store_is_held(spark, tmp_path):
    meet = threading.Barrier(2, timeout=60)

    def slow(spark, k):
        meet.wait()
        return spark.range(k)

    rule = Rule("slow", {"k": int}, {"out": T}, function=slow)
    work = Workspace(spark, str(tmp_path))
    assert [e.state for e in work.execute([rule(1), rule(2)], caps={"threads": 2})] == ["DONE", "DONE"]
    with work.lock(), pytest.raises(StoreLocked):
        work.execute([number(1)])
    assert [e.state for e in work.execute([pair(number(1), number(2))], autoclean=True)] == ["DONE"] * 3
    assert [k.split("/")[0] for k in work._calls()] == ["pair"]


def test_starter_project(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    store = ["--nodes-dir", str(tmp_path / "n"), "--results-dir", str(tmp_path / "r")]
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 1
    run = ["job.toml", *store, "--validation", "pipeline.py:check"]
    assert cli.main(["run", *run, "-n"], spark) == 0 and not (tmp_path / "r").exists()
    assert cli.main(run, spark) == 0
    made = tomllib.loads((tmp_path / "r/job__least+2/manifest.toml").read_text())["outputs"]
    assert {(r.word, r.n) for r in spark.read.parquet(made["frequent"]).collect()} == {("a", 2), ("rose", 2)}
    assert (tmp_path / "r/job__least+1/frequent").is_symlink()
    capsys.readouterr()
    assert cli.main(["explain", "job.toml", *store, "--json", "--invalidate", "counts"], spark) == 0
    assert sorted(r["reason"] for r in json.loads(capsys.readouterr().out)) == ["forced_invalidation", "parent_not_up_to_date", "parent_not_up_to_date", "up_to_date"]
    assert cli.main(["run", "job.toml", *store, "--reap", "all"], spark) == 0
    assert capsys.readouterr().out.count("DONE") == 4
    for verb in ("graph", "outputs", "provenance", "doctor"):
        assert cli.main([verb, "job.toml", *store], spark) == 0
    assert cli.main(["run", "job.toml", *store, "--invalidate", "nothing"], spark) == 1
