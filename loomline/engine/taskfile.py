"""Task files: a header of `-- @key value` lines, then SQL."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from pathlib import Path

from loomline.engine.model import Task, TaskTest

_HEADER = re.compile(r"--\s*@(?P<key>[^\s=]+)[\s=]*(?P<rest>.*)")
ExtractIo = Callable[[str], dict[str, list[str]]]


class TaskError(ValueError):
    pass


def _list(text: str) -> tuple[str, ...]:
    return tuple(p for p in (x.strip() for x in text.split(",")) if p)


def _whole(text: str, line: int, what: str) -> int:
    if not re.fullmatch(r"\+?[0-9]+", text.strip()):
        raise TaskError(f"line {line}: invalid {what}: {text.strip()}")
    return int(text)


def _test(text: str, line: int) -> TaskTest:
    if not text.startswith('"'):
        raise TaskError(f"line {line}: @test needs a query in double quotes")
    end = text.find('"', 1)
    if end < 0:
        raise TaskError(f"line {line}: the query of @test has no closing quote")
    return TaskTest(text[1:end], text[end + 1 :].strip())


def parse_task(text: str, file_path: str | None = None, extract: ExtractIo | None = None) -> Task:
    """The task of one file. Missing inputs or outputs are filled by extract; declared lists are taken as they are.

    The header ends at the first line that is neither blank nor a directive. Unknown keys are ignored; a later
    line overwrites an earlier one, @test lines add up. Without a name the file's stem is the name.
    """
    got: dict = {"tests": ()}
    lines = text.splitlines()
    body = 0
    for n, line in enumerate(lines, 1):
        s = line.strip()
        if not s:
            body = n
            continue
        m = _HEADER.fullmatch(s)
        if not m:
            break
        body = n
        key, rest = m["key"], m["rest"].strip()
        if key == "task":
            for token in rest.split():
                k, _, v = token.partition("=")
                if k == "name" and v:
                    got["name"] = v.strip('"')
        elif key in ("name", "description", "owner", "incremental_by"):
            got[key] = rest
        elif key in ("inputs", "outputs", "depends_on", "tags"):
            got[key] = _list(rest)
        elif key == "schedule":
            got["schedule"] = rest.strip('"')
        elif key == "retries":
            got["retries"] = _whole(rest, n, "retries")
        elif key == "timeout":
            got["timeout_seconds"] = _whole(rest, n, "timeout")
        elif key == "test":
            got["tests"] = (*got["tests"], _test(rest, n))
    sql = "\n".join(lines[body:]).strip()
    name = got.pop("name", None) or (Path(file_path).stem if file_path else None)
    if not name:
        raise TaskError("the task has no name and no file to take it from")
    if extract and not (got.get("inputs") and got.get("outputs")):
        found = extract(sql)
        for k in ("inputs", "outputs"):
            if not got.get(k):
                got[k] = tuple(found[k])
    return Task(name=name, sql=sql, file_path=file_path, **got)


def load_directory(folder: str, extract: ExtractIo | None = None) -> tuple[list[Task], list[dict]]:
    """(tasks, errors) of all .sql files below folder, links followed, in order of path. Errors are collected for
    each file; a name that two files give is one as well, and the later file's task stays."""
    tasks: dict[str, Task] = {}
    errors: list[dict] = []
    for root, folders, files in os.walk(folder, followlinks=True):
        folders.sort()
        for f in sorted(files):
            if not f.endswith(".sql"):
                continue
            path = os.path.join(root, f)
            try:
                task = parse_task(Path(path).read_text(encoding="utf-8"), path, extract)
            except (OSError, ValueError) as e:
                errors.append({"file": path, "error": str(e)})
                continue
            if task.name in tasks:
                errors.append({"file": path, "error": f"task {task.name} is also in {tasks[task.name].file_path}"})
            tasks[task.name] = task
    return list(tasks.values()), errors
