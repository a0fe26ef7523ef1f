"""Job files: TOML or JSON documents, their grids, fields and label sets.  A control plane, read on the driver."""

from __future__ import annotations

import importlib.util
import json
import tomllib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import product
from pathlib import Path
from typing import Any

from .grid import assemble, axes
from .labels import labeller


class ConfigError(ValueError):
    """A job file, field or label set that doesn't hold what is asked of it."""


class NoPipeline(ConfigError):
    """A job names no pipeline."""


class NoLabel(ConfigError):
    """A label was asked for that there isn't."""


class Rejected(ConfigError):
    """A validator rejected a job."""


class NotLoaded(ConfigError):
    """A callable can't be loaded."""


def read_config(path: str | Path) -> dict:
    path = Path(path)
    if path.suffix not in (".toml", ".json"):
        raise ConfigError(f"{path} is neither .toml nor .json")
    text = path.read_text(encoding="utf-8")
    return tomllib.loads(text) if path.suffix == ".toml" else json.loads(text)


def _value(v: Any) -> str:
    if isinstance(v, dict):
        return "{" + ", ".join(f"{json.dumps(k)} = {_value(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(map(_value, v)) + "]"
    if isinstance(v, bool | int | float | str):
        return json.dumps(v, ensure_ascii=False)
    return v.isoformat()


def to_toml(doc: dict) -> str:
    """Top-level keys one by one, tables inline; null fields are left out, as TOML has none."""
    return "".join(f"{json.dumps(k)} = {_value(v)}\n" for k, v in doc.items() if v is not None)


def write_config(path: str | Path, doc: dict) -> None:
    path = Path(path)
    path.write_text(to_toml(doc) if path.suffix == ".toml" else json.dumps(doc, indent=2) + "\n", encoding="utf-8")


def field_path(field: str) -> tuple[str, ...]:
    """Parts of a dotted name; empty parts don't count."""
    if not (parts := tuple(filter(None, field.split(".")))):
        raise ConfigError("an empty field name")
    return parts


def get_field(doc: dict, field: str) -> Any:
    try:
        return reduce(lambda at, k: at[k], field_path(field), doc)
    except (KeyError, TypeError) as error:
        raise ConfigError(f"no field {field}") from error


def set_field(doc: dict, field: str, value: Any) -> dict:
    """The document with one field set; tables on the way are made, a scalar on the way is an error."""
    first, *rest = field_path(field)
    if rest:
        inner = doc.get(first, {})
        if not isinstance(inner, dict):
            raise ConfigError(f"{first} isn't a table")
        value = set_field(inner, ".".join(rest), value)
    return {**doc, first: value}


def copy_with_field(source: str, target: str, *, field: str, value_from: str, value_field: str) -> None:
    """Copy a document, one field taken from another file; all three are of one format."""
    if len({Path(p).suffix for p in (source, target, value_from)}) > 1:
        raise ConfigError("files of different formats")
    write_config(target, set_field(read_config(source), field, get_field(read_config(value_from), value_field)))


@dataclass(frozen=True)
class Job:
    """One config of a job file."""

    label: str
    pipeline: str | None
    requests: tuple[str, ...]
    config: dict


def read_jobs(path: str | Path, *, short: bool = False) -> Iterator[Job]:
    """The jobs of a file, its grid expanded; keys that start with a dot are settings, and no part of a config."""
    doc = read_config(path)
    found = axes(doc)

    def base(place: tuple[str, ...]) -> Any:
        table = reduce(lambda t, k: t.get(k, {}), place[:-1], doc)
        return table.get(place[-1])

    label = labeller(Path(path).stem, found, base, short)
    for at in product(*(range(len(v)) for _, v in found)):
        config = assemble(doc, found, at)
        requests = config.get(".requests", [])
        if not isinstance(requests, list) or not all(isinstance(r, str) for r in requests):
            raise ConfigError(f"{path}: .requests isn't a list of labels")
        yield Job(label(at), config.get(".pipeline"), tuple(requests), {k: v for k, v in config.items() if not k.startswith(".")})


def label_sets(path: str | Path, names: Iterable[str]) -> tuple[str, ...]:
    """Labels of the named sets of a file, each once, in order."""
    if not (names := list(names)):
        return ()
    if not Path(path).exists():
        raise ConfigError(f"no file {path}")
    doc, out = read_config(path), []
    for name in names:
        labels = doc.get(name)
        if not isinstance(labels, list) or not all(isinstance(x, str) for x in labels):
            raise ConfigError(f"{path}: {name} isn't a list of labels")
        out += labels
    return tuple(dict.fromkeys(out))


def load(spec: str) -> Callable:
    """The callable of ``file.py:name``; a file is loaded once."""
    file, _, name = spec.rpartition(":")
    if not file or not name:
        raise NotLoaded(f"{spec} isn't file.py:name")
    try:
        found = getattr(_module(str(Path(file).resolve())), name, None)
    except Exception as error:
        raise NotLoaded(f"{file} can't be loaded: {error}") from error
    if not callable(found):
        raise NotLoaded(f"{file} has no callable {name}")
    return found


@cache
def _module(path: str):
    spec = importlib.util.spec_from_file_location(f"_loomline_{Path(path).stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def validate(job: Job, validators: Iterable[Callable[[dict], Any]]) -> None:
    """Call the validators in order; the first that raises rejects the job."""
    for check in validators:
        try:
            check(job.config)
        except Exception as error:
            raise Rejected(f"{job.label}: {getattr(check, '__name__', check)}: {error}") from error
