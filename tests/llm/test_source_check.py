import ast
import json
import random
import warnings

import pytest

from loomline.llm.source_check import check_files, rates
from loomline.llm.syntax.json_lang import parse_json
from loomline.llm.syntax.python_lang import parse_python
from loomline.llm.syntax.sql_lang import parse_sql

SQL_GOOD = [
    "", ";;", "-- only a comment", "/* a /* nested */ b */", "SELECT 1", "SELECT a, FROM t", "SELECT FROM t", "SELECT case FROM t", "SELECT a AS FROM t", "SELECT 'x;y', \"it''s\" ; SELECT 2;", "SELECT x AND", "SELECT a.b.c, t.*, * EXCEPT (a) FROM t",
    "CREATE OR REPLACE TABLE a.b AS WITH q AS (SELECT * FROM t) SELECT * FROM q WHERE (x IS NULL OR x < 3) AND y BETWEEN 1 AND 2", "INSERT INTO a.b SELECT x FROM y WHERE t > {{ last_processed_at }}", "UPDATE a SET b = 1, c = d WHERE e IN (1, 2)", "DELETE FROM a.b WHERE x IS NOT NULL",
    "MERGE INTO t USING s ON t.i = s.i WHEN MATCHED AND s.d THEN DELETE WHEN NOT MATCHED THEN INSERT (i) VALUES (s.i)", "SELECT sum(a) FILTER (WHERE b) OVER (PARTITION BY c ORDER BY d ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t",
    "SELECT transform(a, x -> x + 1), (x, y) -> x, m['k'], INTERVAL 3 DAYS, DATE '2020-01-01', x::INT, CAST(y AS DECIMAL(10,2)) FROM b", "SELECT * FROM a LEFT SEMI JOIN b USING (k) CROSS JOIN c LATERAL VIEW explode(q) w AS r", "FROM t SELECT a WHERE b", "VALUES (1, 2), (3, 4)",
    "SELECT a FROM t GROUP BY GROUPING SETS ((a), ()) HAVING count(*) > 1 ORDER BY a DESC NULLS LAST LIMIT 3", "CREATE TEMPORARY VIEW v AS SELECT 1", "DROP TABLE IF EXISTS a.b", "SELECT cast(NULL AS STRUCT<a: ARRAY<INT>, b: MAP<STRING, INT>>)", "SET a.b = c d e",
]
SQL_BAD = [
    "SELEC 1", "SELECT", "SELECT 1 +", "SELECT a b c FROM t", "SELECT (1", "SELECT 1)", "SELECT 'open", "SELECT 1 /* open", "INSERT INTO", "CREATE TABLE t AS", "CREATE OR REPLACE TABLE t AS SELECT a FROM t WHERE", "SELECT CAST(a AS BIGINTT) FROM t", "SELECT CAST(a AS VARCHAR) FROM t",
    "<<<<<<< HEAD\nSELECT 1\n=======\nSELECT 2\n>>>>>>> x", "#!/bin/sh\nset -eu", "<!DOCTYPE html><html></html>", "UPDATE t SET WHERE a = 1", "SELECT 1; SELECT FROM FROM FROM t u v", "import json", "SELECT a FROM t WHERE x = = 1", "WHERE a = 1", "{\"a\": 1}", "SELECT été FROM t", "SELECT a, b FROM t GROUP BY", "(a AS b)",
]


@pytest.mark.parametrize("sql", SQL_GOOD)
def test_good_sql(spark, sql):
    assert parse_sql(sql) == []


@pytest.mark.parametrize("sql", SQL_BAD)
def test_bad_sql(sql):
    assert parse_sql(sql)


def test_sql_against_sparks_parser(spark):
    """Mutated statements get the same verdict, but for a few odd uses of keywords as names."""
    parser = spark._jsparkSession.sessionState().sqlParser()

    def real(sql):
        try:
            parser.parsePlan(sql)
            return True
        except Exception:
            return False

    r = random.Random(4)
    good = [s for s in SQL_GOOD if s and "{{" not in s and ";" not in s and not s.startswith(("--", "/*"))]
    wrong = 0
    for _ in range(700):
        s = r.choice(good)
        k = r.randrange(len(s))
        s = r.choice([s[:k], s[:k] + s[k + 1 :], s[:k] + r.choice("(),.'x1 =") + s[k:], s[:k] + s[k + r.randrange(1, 9) :]])
        if s.strip() and ";" not in s:
            wrong += real(s) != (not parse_sql(s))
    assert wrong <= 12


def test_recovery():
    faults = parse_sql("SELECT (;\nSELECT 1;\nSELECT a b c;")
    assert [f.line for f in faults] == [1, 3]
    faults = parse_python("x = = 1\ny = 2\ndef f(:\n    pass\nz = (3\n")
    assert len(faults) >= 3 and faults[0].line == 1
    assert len(parse_json('{"a": 1,, "b": ]}')) >= 1


PYTHON = [
    "", "x = 1", "def f(a, /, b=1, *c, d, **e) -> int:\n    return a if b else c\n", "async def g():\n    async with a as b, c:\n        async for x in y:\n            await z\n", "match x:\n    case [1, *r] if r:\n        pass\n    case {'a': A(b=1), **k} | None:\n        pass\n",
    "f'{a!r:>{w}} {b=} {{}} {\"x\" if c else 1}'", "try:\n    pass\nexcept* E as e:\n    pass\nfinally:\n    pass\n", "@d\nclass A[T: int](B, metaclass=M):\n    x: int = 1\n", "lambda *a, b=1, **k: (yield)", "[x for x in y if x for z in w]", "a = *b, c = d", "with (a as b, c):\n  pass", "print(*a, **b, c=1)",
    "x = 0x1F + 1_000 + 1e5j + .5", "if x:\n\ty\nelse:\n\tz", "type X[T] = list[T]", "if (n := 3) > 2: pass", "del a, b[0], c.d", "x[1:2, ::3, ...]", "global a, b", "from . import (a as b, c,)", "'''x\n''' 'y'", "while 1: break", "{**a, 'b': 1}", "{*a, b}", "assert x, y", "a @= b", "raise X from Y", "x = (\n  1,\n)", "not a in b is not c",
]


def test_python_against_the_compiler():
    r = random.Random(6)

    def real(s):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(s)
            return True
        except (SyntaxError, ValueError):
            return False

    for s in PYTHON:
        assert real(s) and parse_python(s) == [], s
    wrong = 0
    for _ in range(3000):
        s = r.choice(PYTHON[1:])
        k = r.randrange(len(s))
        s = r.choice([s[:k], s[:k] + s[k + 1 :], s[:k] + r.choice("()[]{}:,=.'\"*x1 \n@!") + s[k:], s[:k] + s[k + r.randrange(1, 6) :]])
        wrong += real(s) != (not parse_python(s))
    assert wrong <= 60


def test_json():
    r = random.Random(2)
    good = ['{"a": [1, -2.5e3, true, null, "x\\u00e9\\n"], "b": {}}', "[]", " 1 ", '"x"', '{"a": {"b": [[], {}]}}']

    def real(s):
        try:
            json.loads(s, parse_constant=lambda c: (_ for _ in ()).throw(ValueError()))
            return True
        except ValueError:
            return False

    for s in good:
        assert parse_json(s) == []
    for _ in range(2000):
        s = r.choice(good)
        k = r.randrange(len(s))
        s = r.choice([s[:k], s[:k] + s[k + 1 :], s[:k] + r.choice('{}[],:"1x-.\t') + s[k:]])
        assert real(s) == (not parse_json(s)), s
    assert parse_json("[" * 100_000) and parse_json("") and not parse_json("[" * 5000 + "]" * 5000)


def test_files(spark):
    rows = [
        ("r/a.sql", "SELECT 1", 1), ("r/b.SQL", "SELECT (", 1), ("r/x/c.py", "x = (", 1), ("q/d.json", "{}", 1), ("q/e.json", "", 1), ("q/f.txt", "SELECT (", 1), ("q/g.py", None, 1), ("q/h.py", "", 1), ("q/i.sql", "", 1), (None, "x", 1),
        ("q/j.sql", "SELECT 1 + " * 20000, 1), ("q/k.py", "x = (" * 3000, 1), ("q/l.py", "a\\", 1), ("r/a.sql", "SELECT 1", 1),
    ]
    checked = check_files(spark.createDataFrame(rows, "file_path string, sql string, faults int"), "file_path", "sql").persist()
    bad = {r.path for r in checked.where("size(faults) > 0").collect()}
    assert bad == {"r/b.SQL", "r/x/c.py", "q/e.json", "q/j.sql", "q/k.py", "q/l.py"}
    got = {(r.repository, r.language): (r.n_files, r.n_invalid) for r in rates(checked).collect()}
    assert got[("r", "sql")] == (3, 1) and got[("q", "json")] == (2, 1)
    assert check_files(spark.createDataFrame([], "file_path string, sql string"), "file_path", "sql").count() == 0
