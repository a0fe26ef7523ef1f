"""Typed rules.  Calling a rule makes nodes; nothing runs before a workspace executes them."""

from __future__ import annotations

import ast
import hashlib
import inspect
import json
import re
import textwrap
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

_FIELD = re.compile(r"\{(\w+(?::\w+)?)\}")
#: A name in a template that stands for a folder of side files of the call.
WORKDIR = "workdir"


class ContractError(TypeError):
    """A rule was declared or called against its contract."""


@dataclass(frozen=True)
class ArtifactType:
    """What a dataset is; a subtype may stand where one of its ``parents`` is asked for.

    ``invalidator(node)`` gives a token: while it is the one that was recorded when the
    artifact was made, the artifact holds.
    """

    name: str
    parents: tuple[ArtifactType, ...] = ()
    columns: tuple[str, ...] = ()
    invalidator: Callable[[Node], str] | None = field(default=None, compare=False)

    def is_a(self, other: ArtifactType) -> bool:
        return self == other or any(p.is_a(other) for p in self.parents)


def type_name(wanted: Any) -> str:
    """The name of an input's type; of a union its members, sorted."""
    kinds = wanted if isinstance(wanted, tuple) else (wanted,)
    return "|".join(sorted(getattr(k, "name", None) or k.__name__ for k in kinds))


@dataclass(frozen=True)
class Rule:
    """A Spark SQL template, a DataFrame function, or a link to a table elsewhere.

    ``inputs``: name -> artifact type (a node), tuple of those, or Python type (a
    parameter).  A template may name inputs, ``{constraint:name}`` for a resource, and
    ``{workdir}``; a parameter wins over a resource of its name.  ``version`` is part of
    a function's identity, with its code and what it refers to.  ``link`` names the
    parameter that holds the path of a table that is used in place.  ``repeat`` is kept
    for callers and changes nothing.
    """

    name: str
    inputs: dict[str, Any]
    outputs: dict[str, ArtifactType]
    sql: str | None = None
    function: Callable | None = None
    version: str = ""
    resources: dict[str, int] = field(default_factory=dict)
    link: str | None = None
    repeat: int = 1
    info: str = ""

    def __post_init__(self) -> None:
        if sum(x is not None for x in (self.sql, self.function, self.link)) != 1:
            raise ContractError(f"{self.name}: either sql or a function (or a link) is needed")
        if not self.outputs:
            raise ContractError(f"{self.name}: no outputs")
        if not isinstance(self.repeat, int) or isinstance(self.repeat, bool) or self.repeat < 1:
            raise ContractError(f"{self.name}: repeat isn't a positive whole number")
        for name, wanted in self.inputs.items():
            kinds = wanted if isinstance(wanted, tuple) else (wanted,)
            if not kinds or not all(isinstance(k, ArtifactType | type) for k in kinds) or len({isinstance(k, ArtifactType) for k in kinds}) > 1:
                raise ContractError(f"{self.name}: {name} mixes artifacts and parameters, or is no type")
        if self.link is not None and (self.inputs.get(self.link) is not str or len(self.outputs) > 1):
            raise ContractError(f"{self.name}: a link takes its path as text and has one output")
        if self.sql is not None:
            self._check_template()

    def _check_template(self) -> None:
        named = set(_FIELD.findall(self.sql))
        constraints = {n.removeprefix("constraint:") for n in named if n.startswith("constraint:")}
        if odd := {n for n in named if ":" in n} - {f"constraint:{c}" for c in constraints}:
            raise ContractError(f"{self.name}: unknown names in the template: {', '.join(sorted(odd))}")
        known = {"threads": 1} | self.resources
        if unknown := constraints - known.keys():
            raise ContractError(f"{self.name}: unknown constraints in the template: {', '.join(sorted(unknown))}")
        if unknown := {n for n in named if ":" not in n} - self.inputs.keys() - known.keys() - {WORKDIR}:
            raise ContractError(f"{self.name}: unknown names in the template: {', '.join(sorted(unknown))}")
        if len(self.outputs) > 1:
            raise ContractError(f"{self.name}: an SQL rule has one output")

    @property
    def recipe(self) -> str:
        if self.sql is not None:
            return self.sql
        if self.link is not None:
            return f"link:{self.link}"
        return f"{self.version}\n{code_identity(self.function)}"

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        """Nodes of one call: a node if there is one output, else a tuple in declared order."""
        names = list(self.inputs)
        if len(args) > len(names):
            raise ContractError(f"{self.name}: {len(args)} arguments for {len(names)} inputs")
        given = dict(zip(names, args, strict=False))
        if twice := given.keys() & kwargs.keys():
            raise ContractError(f"{self.name}: given twice: {', '.join(sorted(twice))}")
        given |= kwargs
        if missing := [n for n in names if n not in given]:
            raise ContractError(f"{self.name}: missing {', '.join(missing)}")
        if extra := given.keys() - self.inputs.keys():
            raise ContractError(f"{self.name}: unknown {', '.join(sorted(extra))}")
        parents, config = {}, {}
        for name in names:
            wanted, value = self.inputs[name], given[name]
            kinds = wanted if isinstance(wanted, tuple) else (wanted,)
            if isinstance(kinds[0], ArtifactType):
                if not isinstance(value, Node) or not any(value.type.is_a(k) for k in kinds):
                    raise ContractError(f"{self.name}: {name} isn't a {' | '.join(k.name for k in kinds)}")
                parents[name] = value
            else:
                if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
                    raise ContractError(f"{self.name}: {name} is {type(value).__name__}")
                config[name] = value
        return _nodes_of(Call(self, parents, config))


def code_identity(function: Callable) -> str:
    """A text that changes with a function's code, its defaults, and what it calls or closes over.

    The source where there is one (indented alike), else the byte code; plain values and
    functions of the same package by which it refers to others are followed.
    """
    seen: dict[int, int] = {}

    def of(x: Any) -> str:
        if id(x) in seen:
            return f"<{seen[id(x)]}>"
        if inspect.isfunction(x):
            seen[id(x)] = len(seen)
            try:
                own = textwrap.dedent(inspect.getsource(x))
            except (OSError, TypeError):
                own = x.__code__.co_code.hex() + repr([c for c in x.__code__.co_consts if not inspect.iscode(c)])
            used = inspect.getclosurevars(x)
            top = x.__module__.partition(".")[0]
            near = {n: v for n, v in {**used.nonlocals, **used.globals}.items() if not inspect.isfunction(v) or v.__module__.partition(".")[0] == top}
            rest = "".join(f"\n{n}={of(v)}" for n, v in sorted(near.items()) if inspect.isfunction(v) or isinstance(v, str | int | float | bool | tuple | frozenset | None.__class__))
            return f"{own}{x.__defaults__!r}{rest}"
        return repr(x)

    if not inspect.isfunction(function):
        return getattr(function, "__qualname__", repr(type(function)))
    return of(function)


class Call:
    """A rule with its arguments.  Its fingerprint covers the whole lineage, and is computed once."""

    def __init__(self, rule: Rule, parents: dict[str, Node], config: dict[str, Any], context: dict[str, Any] | None = None):
        self.rule, self.parents, self.config, self.context = rule, parents, config, context or {}
        self.fingerprint = hashlib.sha256(json.dumps(self._identity(), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]

    def _identity(self) -> dict:
        """Resources and ``repeat`` are no part of it."""
        own = {
            "rule": self.rule.name,
            "recipe": self.rule.recipe,
            "config": self.config,
            "parents": [[n, p.call.fingerprint, p.output] for n, p in self.parents.items()],
            "inputs": [[n, type_name(t)] for n, t in sorted(self.rule.inputs.items())],
            "outputs": [[n, t.name] for n, t in self.rule.outputs.items()],
        }
        return own | ({"context": self.context} if self.context else {})


@dataclass(frozen=True, eq=False)
class Node:
    call: Call
    output: str

    @property
    def type(self) -> ArtifactType:
        return self.call.rule.outputs[self.output]

    @property
    def key(self) -> str:
        return f"{self.call.rule.name}/{self.call.fingerprint}/{self.output}"


def _nodes_of(call: Call) -> Any:
    nodes = tuple(Node(call, n) for n in call.rule.outputs)
    return nodes[0] if len(nodes) == 1 else nodes


def lineage(nodes: list[Node]) -> list[Call]:
    """The calls behind ``nodes``, parents first, each once."""
    done: dict[str, Call] = {}
    stack = [(n.call, False) for n in reversed(nodes)]
    while stack:
        call, ready = stack.pop()
        if call.fingerprint in done:
            continue
        if ready:
            done[call.fingerprint] = call
        else:
            stack.append((call, True))
            stack += [(p.call, False) for p in reversed(call.parents.values())]
    return list(done.values())


def in_context(nodes: list[Node], context: dict[str, Any]) -> tuple[list[Node], dict[str, str]]:
    """``nodes`` as they are under another execution context, and their calls' new fingerprints by the old ones."""
    made: dict[str, Call] = {}
    for call in lineage(nodes):
        parents = {n: Node(made[p.call.fingerprint], p.output) for n, p in call.parents.items()}
        made[call.fingerprint] = Call(call.rule, parents, call.config, call.context | context)
    return [Node(made[n.call.fingerprint], n.output) for n in nodes], {old: new.fingerprint for old, new in made.items()}


class Rules:
    """Rules by name.  Decorators take inputs and outputs from annotations: parameters are inputs, what is returned are outputs."""

    def __init__(self) -> None:
        self.by_name: dict[str, Rule] = {}

    def register(self, rule: Rule) -> Rule:
        if rule.name in self.by_name:
            raise ContractError(f"{rule.name} is registered twice")
        self.by_name[rule.name] = rule
        return rule

    def __getitem__(self, name: str) -> Rule:
        return self.by_name[name]

    def command(self, sql: str, **more: Any) -> Callable[[Callable], Rule]:
        """A decorator: the function's annotations with this template."""
        return lambda f: self.register(Rule(f.__name__, *_annotated(f), sql=sql, info=inspect.getdoc(f) or "", **_split(more)))

    def rule(self, f: Callable | None = None, **more: Any) -> Any:
        """A decorator: the template is what the body assigns to ``command``."""
        if f is None:
            return lambda g: self.rule(g, **more)
        return self.register(Rule(f.__name__, *_annotated(f), sql=_command_of(f), info=inspect.getdoc(f) or "", **_split(more)))

    def frame(self, f: Callable | None = None, **more: Any) -> Any:
        """A decorator: the function makes DataFrames; its first parameter is the session."""
        if f is None:
            return lambda g: self.frame(g, **more)
        inputs, outputs = _annotated(f, skip=1)
        return self.register(Rule(f.__name__, inputs, outputs, function=f, info=inspect.getdoc(f) or "", **_split(more)))


def _split(more: dict[str, Any]) -> dict[str, Any]:
    """Keywords of a decorator: those of a rule, and resources."""
    own = {k: more.pop(k) for k in ("version", "repeat") if k in more}
    return own | {"resources": more}


def _annotated(f: Callable, skip: int = 0) -> tuple[dict[str, Any], dict[str, ArtifactType]]:
    hints = inspect.get_annotations(f, eval_str=True)
    names = list(inspect.signature(f).parameters)[skip:]
    if missing := [n for n in names if n not in hints]:
        raise ContractError(f"{f.__name__}: no type for {', '.join(missing)}")
    outputs = hints.get("return")
    if isinstance(outputs, ArtifactType):
        outputs = {"output": outputs}
    if not isinstance(outputs, dict) or not all(isinstance(t, ArtifactType) for t in outputs.values()):
        raise ContractError(f"{f.__name__}: what it returns isn't annotated with artifact types")
    return {n: hints[n] for n in names}, outputs


def _command_of(f: Callable) -> str:
    body = ast.parse(textwrap.dedent(inspect.getsource(f))).body[0].body
    found = [s.value.value for s in body if isinstance(s, ast.Assign) and [getattr(t, "id", None) for t in s.targets] == ["command"] and isinstance(s.value, ast.Constant)]
    if len(found) != 1 or not isinstance(found[0], str):
        raise ContractError(f"{f.__name__}: its body doesn't assign one text to command")
    return found[0]
