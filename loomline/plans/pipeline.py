"""Labelled nodes of a run, as a factory returns them for a config."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from .rules import ContractError, Node, lineage


class Pipeline:
    """Labels of nodes, each set once: ``p.label = node``.  Sections group labels for display and have no part in identity."""

    def __init__(self) -> None:
        object.__setattr__(self, "labels", {})
        object.__setattr__(self, "sections", {})
        object.__setattr__(self, "_section", None)

    def __setattr__(self, label: str, value: Node | tuple[Node, ...]) -> None:
        self.add(label, value)

    def __getattr__(self, label: str) -> Node:
        try:
            return self.__dict__["labels"][label]
        except KeyError:
            raise AttributeError(label) from None

    def add(self, label: str, node: Node) -> None:
        if label.startswith((".", "_")) or label in ("labels", "sections"):
            raise ContractError(f"{label!r} can't be a label")
        if label in self.labels:
            raise ContractError(f"{label} is set twice")
        if not isinstance(node, Node):
            raise ContractError(f"{label} isn't a node")
        self.labels[label] = node
        if self._section is not None:
            self.sections[self._section].append(label)

    @contextmanager
    def section(self, name: str) -> Iterator[None]:
        if not isinstance(name, str) or not name or name in self.sections:
            raise ContractError(f"section {name!r} is empty or not the first of its name")
        self.sections[name] = []
        object.__setattr__(self, "_section", name)
        try:
            yield
        finally:
            object.__setattr__(self, "_section", None)

    def section_of(self, label: str) -> str | None:
        return next((s for s, labels in self.sections.items() if label in labels), None)

    def sinks(self) -> dict[str, Node]:
        """Labelled nodes that no other labelled node is made from."""
        used = {p.key for c in lineage(list(self.labels.values())) for p in c.parents.values()}
        return {n: x for n, x in self.labels.items() if x.key not in used}

    def requested(self, labels: tuple[str, ...] = ()) -> dict[str, Node]:
        """The nodes of ``labels``, or the sinks if none are named."""
        if missing := [x for x in labels if x not in self.labels]:
            raise ContractError(f"no label {', '.join(missing)}")
        return {x: self.labels[x] for x in labels} if labels else self.sinks()
