"""Results by label: a manifest of each job, and links to its outputs where the store is a local folder."""

from __future__ import annotations

import os
from pathlib import Path

from .config import to_toml
from .pipeline import Pipeline
from .rules import lineage
from .workspace import Event, Workspace

MANIFEST, EXECUTION = "manifest.toml", "execution.toml"


def publish(work: Workspace, folder: str, label: str, pipeline: Pipeline, requests: tuple[str, ...] = ()) -> dict[str, str]:
    """Write ``folder/label/manifest.toml`` with the requested outputs that exist, and link them beside it.

    Links of an earlier run go first.  A file that isn't a link is never replaced.
    """
    place = Path(folder) / label
    _drop_links(place)
    place.mkdir(parents=True, exist_ok=True)
    local = "://" not in work.root
    outputs = {name: node for name, node in pipeline.requested(requests).items() if work.exists(node)}
    for name, node in outputs.items() if local else ():
        link = place / (pipeline.section_of(name) or "") / name
        if link.exists() or link.is_symlink():
            raise FileExistsError(f"{link} isn't a link of an earlier run")
        link.parent.mkdir(parents=True, exist_ok=True)
        link.symlink_to(os.path.relpath(work.path(node), link.parent))
    listed = {name: work.path(node) for name, node in outputs.items()}
    (place / MANIFEST).write_text("[outputs]\n" + to_toml(listed), encoding="utf-8")
    return listed


def summarise(folder: str, label: str, pipeline: Pipeline, requests: tuple[str, ...], events: list[Event]) -> list[Event]:
    """Write ``folder/label/execution.toml``: the events of the requested nodes and all they are made from, by key; calls without an event are left out."""
    behind = {c.fingerprint for c in lineage(list(pipeline.requested(requests).values()))}
    own = sorted((e for e in events if e.fingerprint in behind), key=lambda e: (e.rule, e.fingerprint))
    place = Path(folder) / label
    place.mkdir(parents=True, exist_ok=True)
    tables = [f'["{e.rule}/{e.fingerprint}"]\n' + to_toml({k: v for k, v in e.to_dict().items() if k not in ("rule", "fingerprint")}) for e in own]
    (place / EXECUTION).write_text("\n".join(tables), encoding="utf-8")
    return own


def _drop_links(place: Path) -> None:
    """Delete links below a folder, then folders that this leaves empty."""
    for at, folders, files in os.walk(place, topdown=False):
        for name in (*folders, *files):
            if (path := Path(at) / name).is_symlink():
                path.unlink()
        if not os.listdir(at) and Path(at) != place:
            os.rmdir(at)
