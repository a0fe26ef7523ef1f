"""What was run with what: records beside the artifacts, and checks before a run."""

from __future__ import annotations

import json
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from .rules import Call, ContractError, Node, lineage
from .workspace import Event, Workspace

NAME_MAX, PATH_MAX = 255, 4096
_RECORDS = "rule string, fingerprint string, output string, path string, recipe string, config string, parents array<string>"
_EVENTS = "rule string, fingerprint string, state string, seconds double, error string"


def _record(work: Workspace, node: Node) -> tuple:
    """What the store has of a node, or what a run would write if there is nothing."""
    call = node.call
    known = work.record(call)
    config = json.dumps(known.get("config", accumulated_config(call)), sort_keys=True, default=str)
    parents = known.get("parent_keys", [p.key for p in call.parents.values()])
    return call.rule.name, call.fingerprint, node.output, work.path(node), known.get("recipe", call.rule.recipe), config, parents


def accumulated_config(call: Call) -> dict:
    """Parameters of a call and all its ancestors; a later parent wins over an earlier one, the call's own over both."""
    merged: dict[str, dict] = {}
    for c in lineage([Node(call, next(iter(call.rule.outputs)))]):
        own: dict = {}
        for parent in c.parents.values():
            own |= merged[parent.call.fingerprint]
        merged[c.fingerprint] = own | c.config
    return merged[call.fingerprint]


def provenance(work: Workspace, wanted: list[Node]) -> DataFrame:
    """A row for each output of the lineage: rule, fingerprint, path, recipe, accumulated config, parents."""
    rows = [_record(work, Node(c, n)) for c in lineage(wanted) for n in c.rule.outputs]
    return work.spark.createDataFrame(rows, _RECORDS)


def record_events(work: Workspace, events: list[Event]) -> DataFrame:
    """Append what became of the calls of a run to the store's event table, and return that table."""
    path = f"{work.root}/_events"
    rows = [(e.rule, e.fingerprint, e.state, e.seconds, e.error) for e in events]
    work.spark.createDataFrame(rows, _EVENTS).coalesce(1).write.mode("append").parquet(path)
    return work.spark.read.schema(_EVENTS).parquet(path)


#: A label that a job asks for and its pipeline hasn't is a fault of contract.
LabelError = ContractError


@dataclass(frozen=True)
class Issue:
    code: str
    subject: str


def doctor_roots(work: Workspace, results: str) -> list[Issue]:
    """Roots that can't be written to, and a store that a run holds."""
    issues = []
    for root in dict.fromkeys((work.root, results)):
        probe = f"{root}/_probe"
        try:
            work.put(probe, "ok")
            fs, path = work._fs(probe)
            fs.delete(path, False)
        except (PySparkException, Py4JError, OSError) as error:
            issues.append(Issue("LOOM_OUTPUT_ROOT_NOT_WRITABLE", f"{root}: {str(error).splitlines()[0]}"))
    try:
        if work.locked():
            issues.append(Issue("LOOM_NODESTORE_LOCKED", work.root))
    except Py4JError as error:
        issues.append(Issue("LOOM_OUTPUT_ROOT_NOT_WRITABLE", f"{work.root}: {str(error).splitlines()[0]}"))
    return issues


def doctor(work: Workspace, wanted: list[Node], labels: dict[str, Node] | None = None, requests: tuple[str, ...] = ()) -> list[Issue]:
    """What would stop a run: unknown labels, paths that are too long, two rules of one name that differ."""
    issues = [Issue("LOOM_REQUEST_LABEL_NOT_FOUND", r) for r in requests if r not in (labels or {})]
    seen: dict[str, object] = {}
    for call in lineage(wanted):
        if seen.setdefault(call.rule.name, call.rule) is not call.rule:
            issues.append(Issue("LOOM_RULE_NAME_TWICE", call.rule.name))
        for output in call.rule.outputs:
            path = work.path(Node(call, output))
            if len(path.encode()) > PATH_MAX or any(len(p.encode()) > NAME_MAX for p in path.split("/")):
                issues.append(Issue("LOOM_OUTPUT_PATH_TOO_LONG", path))
    return issues


def explain(work: Workspace, wanted: list[Node], force: tuple[str, ...] = ()) -> list[tuple[str, str, str]]:
    """(key, state, reason) of each call that a run would meet, parents first; a row for each reason."""
    found = work.statuses(wanted, force, tolerant=True)
    return [(f"{s.call.rule.name}/{s.call.fingerprint}", s.state, reason) for s in found for reason in s.reasons]


def draw(wanted: list[Node]) -> str:
    """The graph of calls in DOT."""
    calls = lineage(wanted)
    lines = [f'  "{c.fingerprint}" [label="{c.rule.name}"];' for c in calls]
    pairs = dict.fromkeys((p.call.fingerprint, c.fingerprint) for c in calls for p in c.parents.values())
    lines += [f'  "{a}" -> "{b}";' for a, b in pairs]
    return "\n".join(["digraph {", *lines, "}"])
