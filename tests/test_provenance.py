from __future__ import annotations

from loomline.plans import provenance as P
from loomline.plans.rules import ArtifactType, Rule
from loomline.plans.workspace import Workspace

T = ArtifactType("T")
make = Rule("make", {"n": int, "k": str}, {"out": T}, sql="SELECT {n} AS x, {k} AS k")
both = Rule("both", {"a": T, "b": T, "n": int}, {"out": T}, sql="SELECT x, {n} AS n FROM {a} UNION ALL SELECT x, {n} FROM {b}")


def test_config_of_ancestors():
    assert P.accumulated_config(both(make(1, "p"), make(2, "q"), 3).call) == {"n": 3, "k": "q"}


def test_records_and_events(spark, tmp_path):
    work = Workspace(spark, str(tmp_path))
    wanted = both(make(1, "p"), make(2, "q"), 3)
    assert [r for _, _, r in P.explain(work, [wanted])] == ["output_missing"] * 3
    assert P.record_events(work, work.execute([wanted])).where("state = 'DONE'").count() == 3
    assert P.record_events(work, work.execute([wanted])).count() == 6
    assert [r for _, _, r in P.explain(work, [wanted], ("both",))] == ["up_to_date", "up_to_date", "forced_invalidation"]
    assert [r for _, _, r in P.explain(work, [wanted], ("make",))] == ["forced_invalidation", "forced_invalidation", "parent_not_up_to_date"]
    rows = {r.rule: r for r in P.provenance(work, [wanted]).collect()}
    assert rows["both"].config == '{"k": "q", "n": 3}' and len(rows["both"].parents) == 2


def test_doctor(spark):
    wanted = make(1, "p")
    assert P.doctor(Workspace(spark, "/s"), [wanted], {"a": wanted}, ("a",)) == []
    assert [i.code for i in P.doctor(Workspace(spark, "/" + "s" * 300), [wanted], {}, ("a",))] == ["LOOM_REQUEST_LABEL_NOT_FOUND", "LOOM_OUTPUT_PATH_TOO_LONG"]


def test_drawing():
    text = P.draw([both(make(1, "p"), make(1, "p"), 3)])
    assert text.count("->") == 1 and text.count("label=") == 2


def test_parameters_of_sql_are_quoted(spark, tmp_path):
    work = Workspace(spark, str(tmp_path))
    node = make(1, "it's \\ \" -- x")
    work.execute([node])
    assert work.read(node).first().k == "it's \\ \" -- x"
