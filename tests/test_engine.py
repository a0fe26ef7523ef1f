"""Staleness, states, importers and declarations, run through a workspace."""

from __future__ import annotations

import json
import os
import time

import pytest

from loomline import cli
from loomline.plans import importers
from loomline.plans import provenance as P
from loomline.plans.drawing import layered
from loomline.plans.rules import ArtifactType, ContractError, Rule, Rules, in_context, lineage
from loomline.plans.scheduler import RemainingComponents, check_scheduler
from loomline.plans.workspace import RunFailed, StoreLocked, Workspace
from loomline.sources import files

T = ArtifactType("T", columns=("x",))
make = Rule("make", {"n": int}, {"out": T}, sql="SELECT id AS x FROM range({n})")
double = Rule("double", {"t": T}, {"out": T}, sql="SELECT 2 * x AS x FROM {t}")
add = Rule("add", {"a": T, "b": T}, {"out": T}, sql="SELECT x FROM {a} UNION ALL SELECT x FROM {b}")


def _states(work, wanted, **more):
    return [s for _, s in work.plan(wanted, **more)]


def test_a_changed_source_reruns_what_hangs_on_it(spark, tmp_path):
    work, source = Workspace(spark, f"{tmp_path}/store"), f"{tmp_path}/in.parquet"
    spark.range(3).selectExpr("id AS x").write.parquet(source)
    raw, other = importers.link("raw", T)(source), make(2)
    wanted = [add(double(raw), other)]
    work.execute(wanted)
    assert _states(work, wanted) == ["UP_TO_DATE"] * 4
    assert not os.path.exists(f"{tmp_path}/store/raw")
    time.sleep(0.02)
    spark.range(5).selectExpr("id AS x").write.mode("overwrite").parquet(source)
    assert {c.rule.name: s for c, s in work.plan(wanted)} == {"raw": "UP_TO_DATE", "double": "STALE", "make": "UP_TO_DATE", "add": "STALE"}
    assert dict((k.split("/")[0], r) for k, _, r in P.explain(work, wanted))["double"] == "parent_content_changed"
    work.execute(wanted)
    assert work.read(wanted[0]).count() == 7 and _states(work, wanted) == ["UP_TO_DATE"] * 4


def test_a_parent_that_ran_again_with_equal_content_changes_nothing(spark, tmp_path):
    work = Workspace(spark, str(tmp_path))
    first = make(3)
    wanted = [double(first)]
    work.execute(wanted)
    before = work.digest(wanted[0])
    time.sleep(0.02)
    work._timed(first.call, None)
    assert _states(work, wanted) == ["UP_TO_DATE"] * 2
    # Files changed behind the store's back, with other content.
    time.sleep(0.02)
    spark.range(9).selectExpr("id AS x").write.mode("overwrite").parquet(work.path(first))
    assert _states(work, wanted) == ["UP_TO_DATE", "STALE"]
    work.execute(wanted)
    assert work.digest(wanted[0]) != before and work.read(wanted[0]).count() == 9


def test_tokens_and_run_states(spark, tmp_path):
    token = {"now": "1"}
    kind = ArtifactType("K", invalidator=lambda node: token["now"])
    rule = Rule("rule", {}, {"out": kind}, sql="SELECT 1 AS x")
    work, wanted = Workspace(spark, str(tmp_path)), [rule()]
    work.execute(wanted)
    assert _states(work, wanted) == ["UP_TO_DATE"]
    token["now"] = "2"
    assert P.explain(work, wanted)[0][1:] == ("STALE", "invalidator_changed")
    work.execute(wanted)
    assert _states(work, wanted) == ["UP_TO_DATE"]
    work.put(work.meta(wanted[0].call, "state"), "running")
    assert P.explain(work, wanted)[0][1:] == ("STALE", "compromised_prior_state")
    token["now"] = 3
    assert ("STALE", "invalidator_error") in [x[1:] for x in P.explain(work, wanted)]
    with pytest.raises(TypeError):
        work.plan(wanted)


def test_what_is_written_beside_the_outputs(spark, tmp_path):
    work, wanted = Workspace(spark, str(tmp_path)), [double(make(3))]
    event = work.execute(wanted)[-1]
    assert event.size > 0 and event.finished >= event.started and "error" not in event.to_dict()
    call = wanted[0].call
    record = work.record(call)
    assert record["config"] == {"n": 3} and record["outputs"]["out"]["digest"] == work.digest(wanted[0])
    assert work.get(work.meta(call, "state")) == "up_to_date" and "DONE" in work.get(work.meta(call, "log.txt"))
    assert work.get(work.meta(call, "graph.txt")) == layered(wanted) and json.loads(work.get(work.meta(call, "run.json")))["state"] == "DONE"
    cached = work.execute(wanted)[-1]
    assert cached.cached and cached.size == event.size


def test_a_failure_keeps_the_old_outputs_and_the_events(spark, tmp_path):
    fail = {"now": False}

    def two(spark, n):
        if fail["now"]:
            return spark.range(n).selectExpr("id AS x"), spark.range(n).selectExpr("raise_error('no') AS x")
        return spark.range(n).selectExpr("id AS x"), spark.range(n).selectExpr("-id AS x")

    rule = Rule("two", {"n": int}, {"a": T, "b": T}, function=two)
    work = Workspace(spark, str(tmp_path))
    a, b = rule(3)
    work.execute([a, b])
    old = (work.digest(a), work.digest(b))
    fail["now"] = True
    with pytest.raises(RunFailed) as failed:
        work.execute([a, b], force=("two",))
    assert [e.state for e in failed.value.events] == ["FAILED"] and not work.locked()
    assert (work.digest(a), work.digest(b)) == old and not [n for n in os.listdir(work.folder(a.call)) if n.startswith("_new")]
    assert work.get(work.meta(a.call, "state")) == "failed" and "no" in work.get(work.meta(a.call, "log.txt"))
    assert _states(work, [a]) == ["STALE"]
    lazy = work.execute([make(1)], runner=lambda w, c: None, keep_going=True)
    assert lazy[0].state == "FAILED" and "without out" in lazy[0].error


def test_intermediates_go_once_they_are_used(spark, tmp_path):
    work = Workspace(spark, str(tmp_path))
    first = make(3)
    wanted = [add(double(first), double(make(4)))]
    stray = make(9)
    work.execute([stray])
    assert [n.key for n in work.orphans(wanted, [stray, *wanted])] == [stray.key]
    work.execute(wanted, autoclean=True)
    assert work.exists(wanted[0]) and not work.exists(first) and not work.exists(stray)


def test_a_dead_lock_is_taken_over(spark, tmp_path):
    import socket

    work = Workspace(spark, str(tmp_path))
    work.put(f"{tmp_path}/_lock", f"{socket.gethostname()} 999999999")
    with work.lock():
        assert work.locked()
        with pytest.raises(StoreLocked), work.lock():
            pass
    assert not work.locked()


def test_importers(spark, tmp_path):
    work = Workspace(spark, f"{tmp_path}/store")
    with open(f"{tmp_path}/t.TSV", "w") as f:
        f.write("a\tb\n1\tx\n")
    assert files.scan(spark, f"{tmp_path}/t.TSV").collect()[0].b == "x"
    text = importers.text("greeting", ArtifactType("Text"))("hello\n{world}")
    frozen = importers.copy("frozen", ArtifactType("Table"))(f"{tmp_path}/t.TSV")
    work.execute([text, frozen])
    assert work.read(text).first().value == "hello\n{world}"
    with open(f"{tmp_path}/t.TSV", "a") as f:
        f.write("2\ty\n")
    assert _states(work, [frozen]) == ["UP_TO_DATE"] and work.read(frozen).count() == 1
    seen = importers.watched(ArtifactType("Table"), spark)
    fresh = Rule("fresh", {"path": str}, {"table": seen}, function=importers._copied)(f"{tmp_path}/t.TSV")
    work.execute([fresh])
    with open(f"{tmp_path}/t.TSV", "a") as f:
        f.write("3\tz\n")
    assert _states(work, [fresh]) == ["STALE"]
    with pytest.raises(files.UnknownFormat):
        files.scan(spark, "x.unknown")
    exists, _, size = files.stat(spark, f"{tmp_path}/t.TSV")
    assert exists and size == os.path.getsize(f"{tmp_path}/t.TSV") and files.listing(spark, f"{tmp_path}/t.TSV").first().length == size


def test_declarations(spark, tmp_path):
    rules = Rules()

    @rules.command("SELECT {n} * {constraint:threads} AS x", threads=3, repeat=2)
    def scaled(n: int) -> T:
        """Scaled."""

    @rules.rule
    def halved(t: T) -> {"half": T}:
        command = "SELECT x / 2 AS x FROM {t}"

    @rules.frame(version="2")
    def shifted(spark, t: T, by: int) -> T:
        return t.selectExpr(f"x + {by} AS x")

    work = Workspace(spark, str(tmp_path))
    wanted = shifted(halved(scaled(4)), 1)
    work.execute([wanted], caps={"threads": 4})
    assert work.read(wanted).first().x == 7 and rules["scaled"].info == "Scaled." and rules["scaled"].repeat == 2
    with pytest.raises(ContractError, match="twice"):
        rules.register(rules["scaled"])
    for bad in ({"repeat": 0}, {"repeat": True}, {"sql": "SELECT {constraint:gpus}"}, {"inputs": {"a": (T, int)}}, {"sql": "SELECT {nothing}"}):
        with pytest.raises(ContractError):
            Rule("bad", **{"inputs": {}, "outputs": {"out": T}, "sql": "SELECT 1 AS x"} | bad)
    side = Rule("side", {}, {"out": ArtifactType("S")}, sql="SELECT {workdir} AS x")
    node = side()
    work.execute([node])
    assert work.read(node).first().x == f"{work.folder(node.call)}/_work"


def test_identity_covers_what_a_function_refers_to():
    def rule_with(k):
        return Rule("r", {}, {"out": T}, function=lambda spark: spark.range(k))

    assert rule_with(1)().key != rule_with(2)().key and rule_with(1)().key == rule_with(1)().key
    made = eval("lambda spark: spark.range(1)")
    assert Rule("r", {}, {"out": T}, function=made)().key != rule_with(1)().key


def test_context_makes_other_keys():
    wanted = double(make(3))
    (moved,), keys = in_context([wanted], {"shell": "/bin/sh"})
    assert moved.key != wanted.key and keys[wanted.call.fingerprint] == moved.call.fingerprint and len(keys) == 2
    assert in_context([wanted], {})[0][0].key == wanted.key


def test_components_that_fall_apart():
    a, b = make(1), make(2)
    joined = add(double(a), double(b))
    calls = lineage([joined, make(5)])
    order = RemainingComponents()
    order.start(calls)
    assert len(order.known[a.call.fingerprint]) == 5
    looked = order.looked_at
    order.ended([joined.call.fingerprint])
    assert {len(order.known[n.call.fingerprint]) for n in (a, b)} == {2} and order.looked_at == looked + 4
    order.ended([make(5).call.fingerprint])
    assert order.looked_at == looked + 4
    assert [c.rule.name for c in order([a.call, joined.call], {joined.call.fingerprint: 1})] == ["add", "make"]
    with pytest.raises(TypeError):
        check_scheduler(lambda ready: ready)
    check_scheduler(order)


def test_drawing_passes_long_edges():
    a = make(1)
    text = layered([add(double(double(a)), a)])
    assert text.splitlines()[0] == "[make]" and text.count("[double]") == 2 and any(line.count("|") >= 1 and "[double]" in line for line in text.splitlines())


def test_doctor_codes(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "p.py").write_text(
        "from loomline.plans.pipeline import Pipeline\nfrom loomline.plans.rules import ArtifactType, Rule\nT = ArtifactType('T')\nr = Rule('r', {'n': int}, {'out': T}, sql='SELECT {n} AS x')\n"
        "def make(c):\n    p = Pipeline()\n    p.a = r(c['n'])\n    return p\ndef check(c):\n    raise ValueError('no')\n"
    )
    jobs = {
        "ok": '".pipeline" = "p.py:make"\nn = 1\n', "none": "n = 1\n", "bad": "n = [\n", "missing": '".pipeline" = "q.py:make"\nn = 1\n',
        "label": '".pipeline" = "p.py:make"\n".requests" = ["zz"]\nn = 1\n',
    }
    for name, text in jobs.items():
        (tmp_path / f"{name}.toml").write_text(text)

    def codes(job, *more):
        assert cli.main(["doctor", f"{job}.toml", "--json", "--nodes-dir", f"{tmp_path}/nodes", "--results-dir", f"{tmp_path}/results", *more], spark) in (0, 1)
        return {r["code"] for r in json.loads(capsys.readouterr().out)}

    assert codes("ok") == set()
    assert codes("none") == {"LOOM_CONFIG_MISSING_PIPELINE"}
    assert codes("bad") == {"LOOM_CONFIG_PARSE_FAILED"}
    assert codes("missing") == {"LOOM_PIPELINE_IMPORT_FAILED"}
    assert codes("label") == {"LOOM_REQUEST_LABEL_NOT_FOUND"}
    assert codes("ok", "--validation", "p.py:check") == {"LOOM_VALIDATION_FAILED"}
    assert codes("ok", "--constraint", "mem=lots") == {"LOOM_RESOURCE_INVALID"}
    assert codes("ok", "--shellpath", "/no/such") == {"LOOM_SHELLPATH_INVALID"}
    assert codes("ok", "--nodes-dir", f"{tmp_path}/{'n' * 300}") >= {"LOOM_OUTPUT_PATH_TOO_LONG"}
    (tmp_path / "file").write_text("")
    assert "LOOM_OUTPUT_ROOT_NOT_WRITABLE" in codes("ok", "--results-dir", f"{tmp_path}/file/x")
    work = Workspace(spark, f"{tmp_path}/nodes")
    with work.lock():
        assert codes("ok") == {"LOOM_NODESTORE_LOCKED"}


def test_a_failed_run_leaves_its_events(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "p.py").write_text(
        "from loomline.plans.pipeline import Pipeline\nfrom loomline.plans.rules import ArtifactType, Rule\nT = ArtifactType('T')\nr = Rule('r', {'n': int}, {'out': T}, sql='SELECT {n} AS x')\n"
        "b = Rule('b', {'t': T}, {'out': T}, sql='SELECT CAST(raise_error(string(x)) AS INT) AS x FROM {t}')\ndef make(c):\n    p = Pipeline()\n    p.a = r(c['n'])\n    p.z = b(p.a)\n    return p\n"
    )
    (tmp_path / "j.toml").write_text('".pipeline" = "p.py:make"\nn = 1\n')
    roots = ["--nodes-dir", f"{tmp_path}/nodes", "--results-dir", f"{tmp_path}/results"]
    assert cli.main(["run", "j.toml", "--scheduler", "fifo", *roots], spark) == 1
    assert {r.state for r in spark.read.parquet(f"{tmp_path}/nodes/_events").collect()} == {"DONE", "FAILED"}
    summary = (tmp_path / "results/j/execution.toml").read_text()
    assert summary.index('["b/') < summary.index('["r/') and 'state" = "FAILED"' in summary
    capsys.readouterr()
    assert cli.main(["graph", "j.toml", "--json", *roots], spark) == 0
    shown = json.loads(capsys.readouterr().out)
    assert [n["label"] for n in shown["nodes"]] == ["a", "z"] and len(shown["edges"]) == 1
    assert cli.main(["provenance", "j.toml", "--json", *roots], spark) == 0
    assert {r["rule"] for r in json.loads(capsys.readouterr().out)} == {"r", "b"}
