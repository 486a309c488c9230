"""Command line: python -m loomline.cli <command>."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame

from loomline.engine.cron import CronError
from loomline.engine.dag import CycleError
from loomline.engine.engine import Engine, EngineConfig
from loomline.engine.taskfile import parse_task
from loomline.session import local_session


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomline", description="SQL-file pipelines with lineage")
    p.add_argument("--state", default=os.environ.get("LOOMLINE_STATE", ".loomline"), help="folder of the state")
    p.add_argument("--json", action="store_true", help="rows as JSON lines")
    p.add_argument("--parallel", type=int, default=1, help="tasks side by side")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init")
    c.add_parser("register").add_argument("dir")
    r = c.add_parser("run")
    r.add_argument("--task", action="append", help="this task and what it depends on")
    r.add_argument("--full-refresh", action="store_true")
    c.add_parser("status")
    c.add_parser("graph").add_argument("mode", nargs="?", default="lineage")
    c.add_parser("test")
    c.add_parser("validate").add_argument("file")
    c.add_parser("impact").add_argument("table")
    c.add_parser("lineage").add_argument("table")
    c.add_parser("unregister").add_argument("name")
    s = c.add_parser("schedule").add_subparsers(dest="what", required=True)
    a = s.add_parser("add")
    a.add_argument("name")
    a.add_argument("cron")
    for name in ("list", "run-due", "daemon"):
        s.add_parser(name)
    return p


def _show(df: DataFrame, as_json: bool) -> None:
    for row in df.collect():  # reports of metadata
        print(json.dumps(row.asDict(recursive=True), default=str, ensure_ascii=False) if as_json else "\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None, engine: Engine | None = None) -> int:
    """Exit codes: 0 well, 1 a task or test failed, 2 wrong use."""
    args = _parser().parse_args(argv)
    if args.command == "validate":
        try:
            with open(args.file, encoding="utf-8") as f:
                print(json.dumps(parse_task(f.read(), args.file).to_dict(), ensure_ascii=False))
            return 0
        except (OSError, ValueError) as e:
            print(e, file=sys.stderr)
            return 2
    e = engine or Engine(local_session(), EngineConfig(state_dir=args.state, max_parallel=args.parallel))
    if args.command == "init":
        e.init()
    elif args.command == "register":
        errors = e.register(args.dir)
        for x in errors:
            print(f"{x['file']}: {x['error']}", file=sys.stderr)
        _show(e.frame("tasks").select("name", "inputs", "outputs", "depends_on").orderBy("name"), args.json)
        return 1 if errors else 0
    elif args.command == "run":
        try:
            runs = e.run(args.task, args.full_refresh)
        except CycleError as x:
            print(f"{x}: {', '.join(x.names)}", file=sys.stderr)
            return 2
        _show(runs.select("task_name", "status", "rows_count", "retry_count", "error_message"), args.json)
        return 1 if runs.where("status <> 'success'").count() else 0
    elif args.command == "status":
        _show(e.status().select("started_at", "task_name", "status", "rows_count", "retry_count", "error_message"), args.json)
    elif args.command == "graph":
        print(e.mermaid_text(args.mode), end="")
    elif args.command == "test":
        df = e.test()
        _show(df, args.json)
        return 1 if df.where("NOT passed").count() else 0
    elif args.command in ("impact", "lineage"):
        _show(getattr(e, args.command)(args.table), args.json)
    elif args.command == "unregister":
        return 0 if e.unregister(args.name) else 2
    elif args.what == "add":
        try:
            e.schedule_add(args.name, args.cron)
        except CronError as x:
            print(x, file=sys.stderr)
            return 2
    elif args.what == "list":
        _show(e.schedules().select("pipeline_or_task", "cron_expr", "enabled", "next_trigger_at"), args.json)
    elif args.what == "run-due":
        for n in e.run_due():
            print(n)
    else:
        e.daemon()
    return 0


if __name__ == "__main__":
    sys.exit(main())
