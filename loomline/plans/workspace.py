"""A store of artifacts and the runs that fill it."""

from __future__ import annotations

import json
import logging
import os
import socket
import sys
import time
import traceback
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.files import change_token, scan, stat
from .drawing import layered
from .rules import WORKDIR, Call, Node, lineage
from .scheduler import admit, check_scheduler, needs, small_components_first
from .scheduler import components as component_sizes

#: Orders ready calls; sizes of components by fingerprint come with them.
Scheduler = Callable[[Iterable[Call], dict[str, int]], list[Call]]
#: Folder of a call with what is known of it; not part of its outputs.
META = "_meta"
COMPROMISED = ("running", "failed", "interrupted")

log = logging.getLogger("loomline")


class StoreLocked(RuntimeError):
    """Another run holds the store."""


class RunFailed(RuntimeError):
    """A call failed and the run ended; ``events`` tells what became of the calls so far."""

    def __init__(self, message: str, events: list[Event]):
        super().__init__(message)
        self.events = events


@dataclass(frozen=True)
class Event:
    """What became of a call in a run."""

    rule: str
    fingerprint: str
    state: str
    seconds: float = 0.0
    error: str = ""
    cached: bool = False
    size: int | None = None
    started: float | None = None
    finished: float | None = None
    log: str | None = None

    def to_dict(self) -> dict:
        """Without what isn't known."""
        return {k: v for k, v in asdict(self).items() if v is not None and v != ""}


@dataclass(frozen=True)
class Status:
    """State of a call, and why."""

    call: Call
    state: str
    reasons: tuple[str, ...]


class Workspace:
    """Artifacts as Parquet datasets at root/rule/fingerprint/output, on any file system of Spark.

    A dataset counts once it has its ``_SUCCESS`` file; it is written elsewhere and
    moved when all outputs of the call are there.  Rules return lazy DataFrames: inside
    a rule Catalyst optimises; between rules the store decides what runs.  Beside the
    outputs, ``_meta`` holds the state of the last run, provenance with digests of
    contents and tokens, the event, the graph of ancestors and the log.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Places and small files.

    def folder(self, call: Call) -> str:
        return f"{self.root}/{call.rule.name}/{call.fingerprint}"

    def path(self, node: Node) -> str:
        link = node.call.rule.link
        return node.call.config[link] if link else f"{self.root}/{node.key}"

    def exists(self, node: Node) -> bool:
        fs, path = self._fs(self.path(node) if node.call.rule.link else f"{self.path(node)}/_SUCCESS")
        return fs.exists(path)

    def _fs(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def put(self, path: str, text: str) -> None:
        """Write a small file; readers see the old or the new one."""
        fs, there = self._fs(path)
        _, new = self._fs(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        fs.delete(there, False)
        if not fs.rename(new, there):
            raise OSError(f"{path} can't be written")

    def get(self, path: str) -> str | None:
        fs, there = self._fs(path)
        if not fs.exists(there):
            return None
        stream = fs.open(there)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def meta(self, call: Call, name: str) -> str:
        return f"{self.folder(call)}/{META}/{name}"

    def read(self, node: Node) -> DataFrame:
        return scan(self.spark, self.path(node)) if node.call.rule.link else self.spark.read.parquet(self.path(node))

    def record(self, call: Call) -> dict:
        """Provenance as it was written when the call ended, or nothing."""
        text = self.get(self.meta(call, "provenance.json"))
        return json.loads(text) if text else {}

    # What holds and what doesn't.

    def plan(self, wanted: list[Node], force: tuple[str, ...] = ()) -> list[tuple[Call, str]]:
        """Each call of the lineage with its state: MISSING, STALE or UP_TO_DATE; see ``statuses``."""
        return [(s.call, s.state) for s in self.statuses(wanted, force)]

    def statuses(self, wanted: list[Node], force: tuple[str, ...] = (), *, tolerant: bool = False) -> list[Status]:
        """Each call of the lineage, parents first, with its state and all reasons for it.

        A call is STALE if it is forced, its last run didn't end well, a parent runs, a
        parent is newer and has other content than it had then, or a type's token has
        changed.  Content is compared by digests; one is computed again only where files
        were changed behind the store's back.  With ``tolerant``, faults of invalidators
        and of checks of parents are reasons; else they are raised.
        """
        out: list[Status] = []
        runs: set[str] = set()
        for call in lineage(wanted):
            reasons = []
            nodes = [Node(call, n) for n in call.rule.outputs]
            if not all(map(self.exists, nodes)):
                reasons.append("output_missing")
            elif not call.rule.link:
                own = self.record(call)
                if {call.rule.name, call.fingerprint} & set(force):
                    reasons.append("forced_invalidation")
                if (self.get(self.meta(call, "state")) or "").strip() in COMPROMISED:
                    reasons.append("compromised_prior_state")
                try:
                    if any((token := self.token(n)) is not None and token != own.get("outputs", {}).get(n.output, {}).get("token") for n in nodes):
                        reasons.append("invalidator_changed")
                except Exception:
                    if not tolerant:
                        raise
                    reasons.append("invalidator_error")
                if any(p.call.fingerprint in runs for p in call.parents.values()):
                    reasons.append("parent_not_up_to_date")
                try:
                    if any(self._changed(p, own.get("parents", {}).get(name), nodes) for name, p in call.parents.items() if p.call.fingerprint not in runs):
                        reasons.append("parent_content_changed")
                except Exception:
                    if not tolerant:
                        raise
                    reasons.append("parent_check_error")
            state = "MISSING" if reasons == ["output_missing"] else "STALE" if reasons else "UP_TO_DATE"
            if state != "UP_TO_DATE":
                runs.add(call.fingerprint)
            out.append(Status(call, state, tuple(reasons) or ("up_to_date",)))
        return out

    def token(self, node: Node) -> str | None:
        """What the node's type hangs on, if it hangs on anything."""
        if (invalidator := node.type.invalidator) is None:
            return None
        token = invalidator(node)
        if not isinstance(token, str):
            raise TypeError(f"the invalidator of {node.type.name} gave {type(token).__name__}")
        return token

    def _changed(self, parent: Node, then: str | None, nodes: list[Node]) -> bool:
        """Whether a parent is newer than the oldest output and has other content than ``then``."""
        newest = stat(self.spark, self.path(parent))[1]
        if newest <= min(stat(self.spark, self.path(n))[1] for n in nodes):
            return False
        return then is None or self.digest(parent) != then

    def digest(self, node: Node) -> str:
        """The content's digest: of a link its files' times and sizes; else as recorded, or anew if the files aren't those that were recorded."""
        if node.call.rule.link:
            return change_token(self.spark, self.path(node))
        known = self.record(node.call).get("outputs", {}).get(node.output, {})
        _, newest, size = stat(self.spark, self.path(node))
        if known.get("files") == [newest, size]:
            return known["digest"]
        df = self.read(node)
        return _digest(df.agg(*_digest_columns(df)).first().asDict())

    def orphans(self, wanted: list[Node], every: list[Node]) -> list[Node]:
        """Nodes of ``every`` that exist and aren't in the lineage of ``wanted``."""
        needed = {c.fingerprint for c in lineage(wanted)}
        return [n for c in lineage(every) if c.fingerprint not in needed for n in (Node(c, o) for o in c.rule.outputs) if self.exists(n)]

    # Runs.

    def execute(
        self, wanted: list[Node], *, keep_going: bool = False, dry_run: bool = False, force: tuple[str, ...] = (),
        caps: dict[str, int] | None = None, scheduler: Scheduler = small_components_first, autoclean: bool = False,
        runner: Callable[[Workspace, Call], None] | None = None,
    ) -> list[Event]:
        """Make what is missing, as many calls at a time as ``caps`` admit (one thread, unless given); events in order of the plan.

        With ``keep_going``, calls that don't depend on a failed one still run; without,
        the first failure ends the run with ``RunFailed``.  With ``autoclean``, what no
        wanted node is made from goes before, and what only served others goes as soon
        as all that is made from it is there.  ``runner(workspace, call)`` may stand for
        the store's own way to make a call.  A store takes one run at a time.
        """
        check_scheduler(scheduler)
        plan = self.plan(wanted, force)
        if dry_run:
            for call, state in plan:
                if state != "UP_TO_DATE":
                    log.info("would run %s/%s (%s)", call.rule.name, call.fingerprint, state)
            return [Event(c.rule.name, c.fingerprint, s) for c, s in plan]
        caps, sizes = caps or {"threads": 1}, component_sizes(wanted)
        events = {c.fingerprint: self._cached(c) for c, s in plan if s == "UP_TO_DATE"}
        waiting = {c.fingerprint: c for c, s in plan if s != "UP_TO_DATE"}
        running: dict[Future, Call] = {}
        final, children = {n.call.fingerprint for n in wanted}, _children(plan)
        with self.lock(), ThreadPoolExecutor(max(1, min(caps.get("threads", len(plan)), len(plan) or 1))) as pool:
            if autoclean:
                for key in self.remove_orphans(wanted):
                    log.info("removed %s", key)
            while waiting or running:
                for key, call in list(waiting.items()):
                    if any(p.call.fingerprint in events and events[p.call.fingerprint].state in ("FAILED", "INTERRUPTED", "BLOCKED") for p in call.parents.values()):
                        events[key] = Event(call.rule.name, key, "BLOCKED")
                        del waiting[key]
                ready = [c for c in waiting.values() if all(p.call.fingerprint in events for p in c.parents.values())]
                used: dict[str, int] = {}
                for call in running.values():
                    for k, n in needs(call).items():
                        used[k] = used.get(k, 0) + n
                for call in admit(scheduler(ready, sizes), caps, used):
                    log.info("start %s/%s %s threads=%s", call.rule.name, call.fingerprint, call.config, needs(call)["threads"])
                    running[pool.submit(self._timed, call, runner)] = waiting.pop(call.fingerprint)
                for done in wait(running, return_when=FIRST_COMPLETED).done if running else ():
                    call, event = running.pop(done), done.result()
                    events[call.fingerprint] = event
                    log.log(logging.INFO if event.state == "DONE" else logging.ERROR, "%s %s/%s %.1f s %s", event.state.lower(), call.rule.name, call.fingerprint, event.seconds, event.error)
                    if event.state != "DONE" and (not keep_going or event.state == "INTERRUPTED"):
                        for other in running:
                            other.cancel()
                        so_far = [events[c.fingerprint] for c, _ in plan if c.fingerprint in events]
                        raise RunFailed(event.error, so_far)
                    if event.state == "DONE" and autoclean:
                        self._free_parents(call, final, children, events)
        out = [events[c.fingerprint] for c, _ in plan]
        log.info("%s", ", ".join(f"{n} {s.lower()}" for s, n in sorted(_counts(out).items())))
        return out

    def _cached(self, call: Call) -> Event:
        return Event(call.rule.name, call.fingerprint, "UP_TO_DATE", cached=True, size=self.size(call))

    def size(self, call: Call) -> int:
        """Bytes of a call's outputs, without what is known of it."""
        return 0 if call.rule.link else sum(stat(self.spark, self.path(Node(call, n)))[2] for n in call.rule.outputs)

    def _timed(self, call: Call, runner: Callable[[Workspace, Call], None] | None) -> Event:
        began, state, error = time.time(), "DONE", ""
        lines = [f"{call.rule.name}/{call.fingerprint} {json.dumps(call.config, default=str)}", call.rule.recipe]
        marked = not call.rule.link
        try:
            if marked:
                self.put(self.meta(call, "state"), "running")
            (runner or Workspace._run)(self, call)
            if missing := [n for n in call.rule.outputs if not self.exists(Node(call, n))]:
                raise FileNotFoundError(f"{call.rule.name} ended without {', '.join(missing)}")
            if marked:
                self._describe(call)
        except KeyboardInterrupt:
            state, error = "INTERRUPTED", "interrupted"
        except Exception as e:
            state, error = "FAILED", str(e)[:500] or type(e).__name__
            lines.append(traceback.format_exc())
        ended = time.time()
        lines.append(f"{state} after {ended - began:.3f} s")
        path = self.meta(call, "log.txt") if marked else None
        event = Event(call.rule.name, call.fingerprint, state, ended - began, error, False, self.size(call) if state == "DONE" else None, began, ended, path)
        if marked:
            self.put(path, "\n".join(lines))
            self.put(self.meta(call, "run.json"), json.dumps(event.to_dict(), sort_keys=True))
            self.put(self.meta(call, "state"), {"DONE": "up_to_date"}.get(state, state.lower()))
        if state == "FAILED":
            print("\n".join(lines), file=sys.stderr)
        return event

    def _run(self, call: Call) -> None:
        """Write the outputs beside their places, look at them, move them."""
        rule = call.rule
        if rule.link:
            return
        parents = {n: self.read(p) for n, p in call.parents.items()}
        workdir = f"{self.folder(call)}/_work"
        if rule.sql is not None:
            # DataFrames go in as views; the formatter quotes strings, and other parameters have to be plain numbers or booleans.
            if odd := [k for k, v in call.config.items() if not isinstance(v, str | int | float)]:
                raise ValueError(f"{rule.name}: parameters of an SQL rule that aren't scalars: {', '.join(odd)}")
            resources = needs(call)
            sql = rule.sql
            for name in resources:
                sql = sql.replace("{constraint:" + name + "}", str(resources[name]))
            given = resources | {WORKDIR: workdir} | call.config | parents
            made = self.spark.sql(sql, **{n: v for n, v in given.items() if "{" + n + "}" in sql})
        else:
            made = rule.function(self.spark, **parents, **call.config)
        made = made if isinstance(made, tuple) else (made,)
        if len(made) != len(rule.outputs):
            raise ValueError(f"{rule.name} returned {len(made)} DataFrames for {len(rule.outputs)} outputs")
        for (name, kind), df in zip(rule.outputs.items(), made, strict=True):
            if lacking := set(kind.columns) - set(df.columns):
                raise ValueError(f"{rule.name}: {name} lacks {', '.join(sorted(lacking))}")
        aside = f"{self.folder(call)}/_new-{uuid.uuid4().hex}"
        fs, new = self._fs(aside)
        try:
            digests = {}
            for name, df in zip(rule.outputs, made, strict=True):
                # The digest is taken while the rows are written: no scan of its own.
                seen = Observation()
                df.observe(seen, *_digest_columns(df)).write.parquet(f"{aside}/{name}")
                digests[name] = _digest(seen.get)
            self.put(self.meta(call, "digests.json"), json.dumps(digests))
            for name in rule.outputs:
                _, there = self._fs(self.path(Node(call, name)))
                fs.delete(there, True)
                if not fs.rename(self._fs(f"{aside}/{name}")[1], there):
                    raise OSError(f"{there} can't be put in its place")
        finally:
            fs.delete(new, True)

    def _describe(self, call: Call) -> None:
        """Write provenance and the graph of ancestors."""
        from .provenance import accumulated_config

        digests = json.loads(self.get(self.meta(call, "digests.json")) or "{}")
        outputs = {}
        for name in call.rule.outputs:
            node = Node(call, name)
            _, newest, size = stat(self.spark, self.path(node))
            outputs[name] = {"digest": digests.get(name) or self.digest(node), "files": [newest, size], "path": self.path(node)}
            if (token := self.token(node)) is not None:
                outputs[name]["token"] = token
        record = {
            "rule": call.rule.name, "fingerprint": call.fingerprint, "recipe": call.rule.recipe, "config": accumulated_config(call), "context": call.context,
            "parents": {n: self.digest(p) for n, p in call.parents.items()}, "parent_keys": [p.key for p in call.parents.values()], "outputs": outputs,
        }
        self.put(self.meta(call, "provenance.json"), json.dumps(record, sort_keys=True, default=str, indent=1))
        self.put(self.meta(call, "graph.txt"), layered([Node(call, next(iter(call.rule.outputs)))]))

    def _free_parents(self, call: Call, final: set[str], children: dict[str, set[str]], events: dict[str, Event]) -> None:
        """Delete the parents that aren't wanted and that nothing is still to be made from."""
        fs, _ = self._fs(self.root)
        for parent in {p.call.fingerprint: p.call for p in call.parents.values()}.values():
            over = all(c in events and events[c].state in ("DONE", "UP_TO_DATE") for c in children[parent.fingerprint])
            if parent.fingerprint not in final and over and not parent.rule.link:
                fs.delete(self._fs(self.folder(parent))[1], True)
                log.info("removed %s/%s", parent.rule.name, parent.fingerprint)

    # The store as a whole.

    @contextmanager
    def lock(self) -> Iterator[None]:
        """Hold the store: a file that only one run can create, on any file system of Spark; one of a process of this machine that has died is taken over."""
        fs, path = self._fs(f"{self.root}/_lock")
        fs.mkdirs(path.getParent())
        if not fs.createNewFile(path):
            host, _, pid = (self.get(f"{self.root}/_lock") or "").partition(" ")
            if host != socket.gethostname() or not pid.isdigit() or _alive(int(pid)):
                raise StoreLocked(f"another run holds {self.root}; if there is none, delete {path}")
        self.put(f"{self.root}/_lock", f"{socket.gethostname()} {os.getpid()}")
        try:
            yield
        finally:
            fs.delete(path, False)

    def locked(self) -> bool:
        fs, path = self._fs(f"{self.root}/_lock")
        return fs.exists(path)

    def _calls(self) -> dict[str, object]:
        """Directories of calls in the store by rule/fingerprint; names that start with an underscore are no rules."""
        fs, root = self._fs(self.root)
        folders = [r for r in fs.listStatus(root) if r.isDirectory() and not r.getPath().getName().startswith("_")] if fs.exists(root) else []
        return {f"{r.getPath().getName()}/{c.getPath().getName()}": c.getPath() for r in folders for c in fs.listStatus(r.getPath())}

    def remove_orphans(self, wanted: list[Node]) -> list[str]:
        """Delete calls that aren't in the lineage of ``wanted``."""
        keep = {f"{c.rule.name}/{c.fingerprint}" for c in lineage(wanted)}
        return self._remove({k: p for k, p in self._calls().items() if k not in keep})

    def remove_intermediates(self, wanted: list[Node]) -> list[str]:
        """Delete calls of the lineage that only served others."""
        keep = {f"{n.call.rule.name}/{n.call.fingerprint}" for n in wanted}
        within = {f"{c.rule.name}/{c.fingerprint}" for c in lineage(wanted)} - keep
        return self._remove({k: p for k, p in self._calls().items() if k in within})

    def _remove(self, paths: dict[str, object]) -> list[str]:
        fs, _ = self._fs(self.root)
        for path in paths.values():
            fs.delete(path, True)
        return sorted(paths)


def _digest_columns(df: DataFrame) -> list:
    """Aggregates that are the same for the same rows in any order."""
    plain = [F.to_json(F.struct(df[f"`{f.name}`"])) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else df[f"`{f.name}`"] for f in df.schema.fields]
    sums = [F.sum(F.xxhash64(F.lit(k), *plain).cast("decimal(38,0)")).cast("string").alias(f"h{k}") for k in (1, 2)]
    return [F.count(F.lit(1)).alias("n"), *sums]


def _digest(row: dict) -> str:
    return f"{row['n']}:{row['h1']}:{row['h2']}"


def _children(plan: list[tuple[Call, str]]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {c.fingerprint: set() for c, _ in plan}
    for call, _ in plan:
        for p in call.parents.values():
            out[p.call.fingerprint].add(call.fingerprint)
    return out


def _counts(events: list[Event]) -> dict[str, int]:
    out: dict[str, int] = {}
    for e in events:
        out[e.state] = out.get(e.state, 0) + 1
    return out


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True
