"""The graph of calls as text: one line for each layer, with marks where an edge passes a layer."""

from __future__ import annotations

from .rules import Call, Node, lineage

PASS = "|"


def label(call: Call) -> str:
    """What a call is shown as: its rule, and its outputs where there are several."""
    outputs = list(call.rule.outputs)
    return f"[{call.rule.name}{': ' + ', '.join(outputs) if len(outputs) > 1 else ''}]"


def layers(calls: list[Call]) -> dict[str, int]:
    """Fingerprint -> longest distance from a call without parents; ``calls`` come parents first."""
    out: dict[str, int] = {}
    for call in calls:
        out[call.fingerprint] = max((out[p.call.fingerprint] + 1 for p in call.parents.values()), default=0)
    return out


def layered(wanted: list[Node]) -> str:
    """Layers from sources down; between two of them a line with the edges, by the places they start and end at."""
    calls = lineage(wanted)
    level = layers(calls)
    rows: list[list[tuple[str, str]]] = [[] for _ in range(max(level.values(), default=-1) + 1)]
    for call in calls:
        rows[level[call.fingerprint]].append((call.fingerprint, label(call)))
    hops: list[tuple[int, str, str]] = []
    for call in calls:
        for parent in dict.fromkeys(p.call.fingerprint for p in call.parents.values()):
            at = parent
            for k in range(level[parent] + 1, level[call.fingerprint]):
                through = f"{parent}>{call.fingerprint}@{k}"
                rows[k].append((through, PASS))
                hops.append((k - 1, at, through))
                at = through
            hops.append((level[call.fingerprint] - 1, at, call.fingerprint))
    lines, places = [], []
    for row in rows:
        text, middle = "", {}
        for key, shown in row:
            middle[key] = len(text) + len(shown) // 2
            text += shown + "   "
        lines.append(text.rstrip())
        places.append(middle)
    out = []
    for k, line in enumerate(lines):
        out.append(line)
        out += connectors([(places[k][a], places[k + 1][b]) for at, a, b in hops if at == k])
    return "\n".join(out)


def connectors(edges: list[tuple[int, int]]) -> list[str]:
    """One line for edges that go straight down, and one for each that bends."""
    out = []
    if straight := {a for a, b in edges if a == b}:
        out.append("".join(PASS if x in straight else " " for x in range(max(straight) + 1)))
    for a, b in sorted(edges):
        if a != b:
            lo, hi = min(a, b), max(a, b)
            out.append(" " * lo + "+" + "-" * (hi - lo - 1) + "+")
    return out
