"""Command line: ``python -m loomline run job.toml``, and read-outs of what a run would do or has done."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .functions.scalar import SUFFIXES
from .plans import config as C
from .plans import provenance as P
from .plans.pipeline import Pipeline
from .plans.drawing import layered
from .plans.results import publish, summarise
from .plans.rules import Node, in_context, lineage
from .plans.scheduler import BUILT_IN, check_scheduler, small_components_first
from .plans.workspace import RunFailed, Workspace

VERBS = ("run", "init", "graph", "outputs", "provenance", "doctor", "explain", "set-field")

STARTER = {
    "pipeline.py": '''"""Words of a text, counted by Spark SQL."""

from loomline.plans.pipeline import Pipeline
from loomline.plans.rules import ArtifactType, Rule

WORDS, COUNTS = ArtifactType("Words", columns=("word",)), ArtifactType("Counts", columns=("word", "n"))
words = Rule("words", {"text": str}, {"words": WORDS}, sql="SELECT explode(split({text}, ' ')) AS word")
count = Rule("count", {"words": WORDS}, {"counts": COUNTS}, sql="SELECT word, count(*) AS n FROM {words} GROUP BY word")
frequent = Rule("frequent", {"counts": COUNTS, "least": int}, {"counts": COUNTS}, sql="SELECT * FROM {counts} WHERE n >= {least}")


def make(config):
    p = Pipeline()
    p.words = words(config["text"])
    p.counts = count(p.words)
    p.frequent = frequent(p.counts, config["least"])
    return p


def check(config):
    if config["least"] < 1:
        raise ValueError("least is below 1")
''',
    "job.toml": '".pipeline" = "pipeline.py:make"\ntext = "a rose is a rose"\nleast__grid = [1, 2]\n',
    "reap.toml": 'all = ["words", "counts", "frequent"]\n',
}


def amount(text: str) -> int:
    """``12``, ``4K`` or ``2Gi`` as a number."""
    found = re.fullmatch(r"(\d+)([KMGTP]i?)?", text)
    if not found:
        raise C.ConfigError(f"{text} isn't an amount")
    return int(found[1]) * SUFFIXES.get(found[2], 1)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="loomline")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("run", "graph", "outputs", "provenance", "doctor", "explain"):
        sub = verbs.add_parser(verb)
        sub.add_argument("jobs", nargs="+", metavar="JOB")
        sub.add_argument("--nodes-dir", default="nodes", help="root of the store, on any file system of Spark")
        sub.add_argument("--results-dir", default="results")
        sub.add_argument("--outdir", "-o", help="one directory for both")
        sub.add_argument("--validation", action="append", default=[], metavar="FILE.py:NAME")
        sub.add_argument("--invalidate", action="append", default=[], metavar="LABEL")
        sub.add_argument("--reap", action="append", default=[], metavar="NAME")
        sub.add_argument("--reap-file", default="reap.toml")
        sub.add_argument("--json", action="store_true")
        sub.add_argument("--shellpath", metavar="PATH", help="shell of commands that rules start; part of what is run")
        if verb in ("run", "doctor"):
            sub.add_argument("-c", dest="cores", default="all", metavar="N|all")
            sub.add_argument("--constraint", action="append", default=[], metavar="KEY=AMOUNT")
        if verb == "run":
            sub.add_argument("--keep-going", "-k", action="store_true")
            sub.add_argument("--dry-run", "-n", action="store_true")
            sub.add_argument("--autoclean", action="store_true")
            sub.add_argument("--scheduler", metavar="|".join([*BUILT_IN, "FILE.py:NAME"]))
    verbs.add_parser("init").add_argument("folder", nargs="?", default=".")
    edit = verbs.add_parser("set-field", help="copy a config, one field taken from another file")
    for name in ("source", "target", "field", "value_from", "value_field"):
        edit.add_argument(name)
    return parser


def caps(cores: str, constraints: list[str]) -> dict[str, int]:
    """Limits of resources; ``threads`` as a constraint wins over ``-c``."""
    out = {"threads": (os.cpu_count() or 1) if cores == "all" else amount(cores)}
    for text in constraints:
        name, sign, value = text.partition("=")
        if not name or not sign:
            raise C.ConfigError(f"{text} isn't KEY=AMOUNT")
        out[name] = amount(value)
    return out


def shell(path: str | None) -> dict[str, str]:
    """The execution context that a shell makes; it must be a file that can be run."""
    if path is None:
        return {}
    if not os.path.isfile(path) or not os.access(path, os.X_OK):
        raise C.ConfigError(f"{path} isn't a shell that can be run")
    return {"shell": os.path.realpath(path)}


class _Loaded:
    """The jobs of the command line with their pipelines."""

    def __init__(self, args: argparse.Namespace):
        context = shell(args.shellpath)
        checks = [C.load(v) for v in args.validation]
        self.jobs: list[tuple[C.Job, Pipeline]] = []
        for path in args.jobs:
            for job in C.read_jobs(path):
                if not job.pipeline:
                    raise C.NoPipeline(f"{path} names no .pipeline")
                C.validate(job, checks)
                pipeline = C.load(job.pipeline)(job.config)
                if context:
                    names = list(pipeline.labels)
                    pipeline.labels.update(zip(names, in_context(list(pipeline.labels.values()), context)[0], strict=True))
                self.jobs.append((job, pipeline))
        self.wanted = [n for job, p in self.jobs for n in p.requested(job.requests).values()]
        labels = dict.fromkeys((*args.invalidate, *C.label_sets(args.reap_file, args.reap)))
        self.forced = tuple({n.call.fingerprint for x in labels for n in self._nodes(x)})

    def _nodes(self, label: str) -> list[Node]:
        if not (found := [p.labels[label] for _, p in self.jobs if label in p.labels]):
            raise C.NoLabel(f"no label {label}")
        return found


def _show(rows: list[dict], as_json: bool) -> None:
    if as_json:
        print(json.dumps(rows, indent=2, sort_keys=True, default=str))
    else:
        for row in rows:
            print("\t".join(str(v) for v in row.values()))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; the exit code.  A job file without a verb is run."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in VERBS and not argv[0].startswith("-"):
        argv.insert(0, "run")
    args = _parser().parse_args(argv)
    try:
        return _dispatch(args, spark)
    except (C.ConfigError, PySparkException, TypeError, OSError, RuntimeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


def _dispatch(args: argparse.Namespace, spark: SparkSession | None) -> int:
    if args.verb == "init":
        return _init(Path(args.folder))
    if args.verb == "set-field":
        C.copy_with_field(args.source, args.target, field=args.field, value_from=args.value_from, value_field=args.value_field)
        return 0
    if args.verb == "doctor":
        return _doctor(args, spark)
    loaded = _Loaded(args)
    spark = spark or SparkSession.builder.appName("loomline").getOrCreate()
    work, results = Workspace(spark, args.outdir or args.nodes_dir), args.outdir or args.results_dir
    if args.verb == "run":
        return _run(args, loaded, work, results)
    if args.verb == "graph":
        if args.json:
            calls = lineage(loaded.wanted)
            labels = {x.key: n for _, p in loaded.jobs for n, x in p.labels.items()}
            nodes = [{"key": (x := Node(c, o)).key, "rule": c.rule.name, "output": o, "type": x.type.name, "label": labels.get(x.key, o), "path": work.path(x), "config": c.config} for c in calls for o in c.rule.outputs]
            edges = [{"child": Node(c, o).key, "parent": p.key, "input": n} for c in calls for o in c.rule.outputs for n, p in c.parents.items()]
            print(json.dumps({"nodes": nodes, "edges": edges}, indent=2, sort_keys=True, default=str))
        else:
            print(layered(loaded.wanted))
    elif args.verb == "outputs":
        _show([{"job": j.label, "label": n, "path": work.path(x), "exists": work.exists(x)} for j, p in loaded.jobs for n, x in p.requested(j.requests).items()], args.json)
    elif args.verb == "provenance":
        _show([r.asDict() for r in P.provenance(work, loaded.wanted).collect()], args.json)
    elif args.verb == "explain":
        _show([{"key": k, "state": s, "reason": r} for k, s, r in P.explain(work, loaded.wanted, loaded.forced)], args.json)
    return 0


def _run(args: argparse.Namespace, loaded: _Loaded, work: Workspace, results: str) -> int:
    order = BUILT_IN.get(args.scheduler) or (C.load(args.scheduler) if args.scheduler else small_components_first)
    check_scheduler(order)
    failed = ""
    try:
        events = work.execute(
            loaded.wanted, keep_going=args.keep_going, dry_run=args.dry_run, force=loaded.forced, caps=caps(args.cores, args.constraint), scheduler=order, autoclean=args.autoclean
        )
    except RunFailed as error:
        events, failed = error.events, str(error)
    _show([{"state": e.state, "rule": e.rule, "fingerprint": e.fingerprint, "seconds": round(e.seconds, 3), "error": e.error} for e in events], args.json)
    if not args.dry_run:
        P.record_events(work, events)
        for job, pipeline in loaded.jobs:
            publish(work, results, job.label, pipeline, job.requests)
            summarise(results, job.label, pipeline, job.requests, events)
    if failed:
        print(f"error: {failed}", file=sys.stderr)
    return 1 if failed or any(e.state in ("FAILED", "INTERRUPTED", "BLOCKED") for e in events) else 0


#: What a fault in loading the jobs is called.
_CODES = ((C.NoPipeline, "LOOM_CONFIG_MISSING_PIPELINE"), (C.NoLabel, "LOOM_REQUEST_LABEL_NOT_FOUND"), (C.Rejected, "LOOM_VALIDATION_FAILED"), (C.NotLoaded, "LOOM_PIPELINE_IMPORT_FAILED"))


def _doctor(args: argparse.Namespace, spark: SparkSession | None) -> int:
    """All that would stop a run, as far as it can be seen; exit code 1 if there is anything."""
    issues: list[P.Issue] = []
    for check, code in ((lambda: shell(args.shellpath), "LOOM_SHELLPATH_INVALID"), (lambda: caps(args.cores, args.constraint), "LOOM_RESOURCE_INVALID")):
        try:
            check()
        except C.ConfigError as error:
            issues.append(P.Issue(code, str(error)))
    args.shellpath = None if any(i.code == "LOOM_SHELLPATH_INVALID" for i in issues) else args.shellpath
    spark = spark or SparkSession.builder.appName("loomline").getOrCreate()
    work, results = Workspace(spark, args.outdir or args.nodes_dir), args.outdir or args.results_dir
    try:
        loaded = _Loaded(args)
    except Exception as error:
        code = next((c for kind, c in _CODES if isinstance(error, kind)), None)
        if code is None and isinstance(error, P.LabelError):
            code = "LOOM_REQUEST_LABEL_NOT_FOUND"
        plain = isinstance(error, (C.ConfigError, ValueError, OSError)) and code is None
        issues.append(P.Issue(code or ("LOOM_CONFIG_PARSE_FAILED" if plain else "LOOM_PIPELINE_IMPORT_FAILED"), str(error)))
    else:
        issues += P.doctor(work, loaded.wanted)
    issues += P.doctor_roots(work, results)
    _show([{"code": i.code, "subject": i.subject} for i in issues], args.json)
    return 1 if issues else 0


def _init(folder: Path) -> int:
    """Write the starter project; files that exist stop it."""
    if there := [n for n in STARTER if (folder / n).exists()]:
        raise C.ConfigError(f"{folder} has {', '.join(there)}")
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in STARTER.items():
        (folder / name).write_text(text, encoding="utf-8")
    return 0
