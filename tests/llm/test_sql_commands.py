import random
import sys
import time

import pytest

from loomline.llm.syntax.sql_lang import parse_sql

GOOD = [
    "ALTER TABLE a.b ADD COLUMNS (x INT, y.z STRING COMMENT 'c' AFTER x)", "ALTER TABLE t ADD COLUMN x INT NOT NULL FIRST", "ALTER TABLE t ADD COLUMN x INT DEFAULT 1 + 2", "ALTER TABLE t DROP COLUMNS IF EXISTS (a, b.c)", "ALTER TABLE t DROP COLUMN a", "ALTER TABLE t RENAME TO u.v",
    "ALTER TABLE t RENAME COLUMN a.b TO c", "ALTER TABLE t ALTER COLUMN a TYPE BIGINT", "ALTER TABLE t ALTER COLUMN a SET NOT NULL", "ALTER TABLE t ALTER a DROP NOT NULL", "ALTER TABLE t ALTER COLUMN a SET DEFAULT 3", "ALTER TABLE t ALTER COLUMN a DROP DEFAULT", "ALTER TABLE t ALTER COLUMN a COMMENT 'x'", "ALTER TABLE t ALTER COLUMN a AFTER b",
    "ALTER TABLE t CHANGE COLUMN a A INT COMMENT 'x'", "ALTER TABLE t CHANGE a a STRING FIRST", "ALTER TABLE t CHANGE COLUMN a TYPE INT", "ALTER TABLE t REPLACE COLUMNS (a INT, b STRING)", "ALTER TABLE t SET TBLPROPERTIES ('a' = 'b', c.d = 1)", "ALTER TABLE t UNSET TBLPROPERTIES IF EXISTS ('a')", "ALTER TABLE t ADD IF NOT EXISTS PARTITION (d = '1') LOCATION 'x' PARTITION (d = '2')",
    "ALTER TABLE t DROP IF EXISTS PARTITION (d = 1), PARTITION (d = 2) PURGE", "ALTER TABLE t PARTITION (d = 1) RENAME TO PARTITION (d = 2)", "ALTER TABLE t SET LOCATION 'x'", "ALTER TABLE t PARTITION (d = 1) SET LOCATION 'x'", "ALTER TABLE t SET SERDE 'x' WITH SERDEPROPERTIES ('a' = 'b')", "ALTER TABLE t SET SERDEPROPERTIES ('a' = 'b')", "ALTER TABLE t RECOVER PARTITIONS", "ALTER TABLE t CLUSTER BY (a, b.c)", "ALTER TABLE t CLUSTER BY NONE", "ALTER TABLE t ADD CONSTRAINT c CHECK (a > 1)", "ALTER TABLE t DROP CONSTRAINT IF EXISTS c CASCADE",
    "ALTER VIEW v AS SELECT 1", "ALTER VIEW v SELECT 1", "ALTER VIEW v RENAME TO w", "ALTER VIEW v SET TBLPROPERTIES ('a' = 'b')", "ALTER VIEW v WITH SCHEMA TYPE EVOLUTION", "ALTER VIEW v WITH SCHEMA BINDING", "ALTER DATABASE d SET DBPROPERTIES ('a' = 'b')", "ALTER SCHEMA d SET LOCATION 'x'", "ALTER NAMESPACE a.b UNSET PROPERTIES ('a')",
    "SHOW TABLES", "SHOW TABLES IN a.b LIKE 'x*'", "SHOW TABLES 'x'", "SHOW DATABASES LIKE 'x'", "SHOW SCHEMAS", "SHOW NAMESPACES IN a", "SHOW TABLE EXTENDED IN a LIKE 'x' PARTITION (d = 1)", "SHOW TBLPROPERTIES t", "SHOW TBLPROPERTIES t ('a.b')", "SHOW TBLPROPERTIES t (a.b)", "SHOW COLUMNS IN t", "SHOW COLUMNS FROM t IN d", "SHOW VIEWS FROM d", "SHOW PARTITIONS t PARTITION (d = 1)", "SHOW FUNCTIONS", "SHOW USER FUNCTIONS LIKE 'x'", "SHOW ALL FUNCTIONS a.b", "SHOW FUNCTIONS IN d LIKE 'a'", "SHOW CREATE TABLE t AS SERDE", "SHOW CURRENT DATABASE", "SHOW CATALOGS", "SHOW CATALOGS LIKE 'a'",
    "DESCRIBE t", "DESC EXTENDED a.b", "DESCRIBE TABLE FORMATTED a.b PARTITION (d = 1)", "DESC t a.b", "DESCRIBE EXTENDED t AS JSON", "DESCRIBE FUNCTION EXTENDED abs", "DESC FUNCTION '+'", "DESC FUNCTION +", "DESC DATABASE EXTENDED d", "DESCRIBE QUERY SELECT 1", "DESCRIBE SELECT 1", "DESC WITH q AS (SELECT 1) SELECT * FROM q", "DESCRIBE VALUES (1)", "DESC TABLE t", "DESC EXTENDED", "DESC TABLE", "DESC QUERY TABLE t",
    "ANALYZE TABLE t COMPUTE STATISTICS", "ANALYZE TABLE a.b PARTITION (d, e = 1) COMPUTE STATISTICS NOSCAN", "ANALYZE TABLE t COMPUTE STATISTICS FOR COLUMNS a, b", "ANALYZE TABLE t COMPUTE STATISTICS FOR ALL COLUMNS", "ANALYZE TABLES IN d COMPUTE STATISTICS NOSCAN", "ANALYZE TABLES COMPUTE STATISTICS",
    "REFRESH TABLE a.b", "REFRESH FUNCTION f", "REFRESH 'a b'", "REFRESH /a/b.c", "REFRESH a", "LOAD DATA LOCAL INPATH 'x' OVERWRITE INTO TABLE t PARTITION (d = 1)", "LOAD DATA INPATH 'x' INTO TABLE t", "MSCK REPAIR TABLE t SYNC PARTITIONS", "REPAIR TABLE t", "MSCK REPAIR TABLE a.b", "CLEAR CACHE",
    "DECLARE x INT", "DECLARE OR REPLACE VARIABLE x INT DEFAULT 1 + 2", "DECLARE VAR a.b = 3", "DECLARE x, y INT DEFAULT 1", "DECLARE VARIABLE x DEFAULT (SELECT 1)", "EXECUTE IMMEDIATE 'SELECT 1'", "EXECUTE IMMEDIATE q INTO a, b USING 1, x AS y", "EXECUTE IMMEDIATE 'SELECT ?' USING (1, 2 AS b)", "CALL a.b.c()", "CALL p(1, x => 'y')",
    "SET", "SET a.b = c d", "SET a.b", "SET -v", "SET TIME ZONE LOCAL", "SET TIME ZONE 'UTC'", "SET TIME ZONE INTERVAL 1 HOUR", "SET VAR x = 1", "SET VARIABLE a = 1, b = (SELECT 2)", "SET VAR (a, b) = (SELECT 1, 2)", "SET `a-b` = 3", "RESET", "RESET a.b", "RESET `a b`",
    "CREATE FUNCTION f AS 'a.B' USING JAR 'x.jar', FILE 'y'", "CREATE OR REPLACE TEMPORARY FUNCTION f AS 'a.B'", "CREATE FUNCTION f(x INT DEFAULT 1 COMMENT 'c', y STRING) RETURNS INT LANGUAGE SQL DETERMINISTIC COMMENT 'c' CONTAINS SQL RETURN x + 1", "CREATE FUNCTION IF NOT EXISTS a.f() RETURN SELECT 1", "CREATE FUNCTION f(x INT) RETURNS TABLE (a INT, b STRING) RETURN SELECT 1, 'x'",
    "SELECT TRANSFORM (a, b) USING 'cat' AS (x INT, y STRING) FROM t", "SELECT TRANSFORM (a, b) USING 'cat' AS x, y FROM t", "MAP a, b USING 'cat' AS x, y FROM t", "REDUCE a ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' USING 'cat' AS (x STRING) FROM t", "CREATE TABLE t (a INT) ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' ESCAPED BY 'x' MAP KEYS TERMINATED BY 'y' STORED AS TEXTFILE", "CREATE TABLE t (a INT) ROW FORMAT SERDE 'x' WITH SERDEPROPERTIES ('a' = 'b')",
]
BAD = [
    "ALTER TABLE", "ALTER TABLE t", "ALTER TABLE t ADD COLUMNS (x INT) <<<<<<< HEAD", "ALTER TABLE t ADD COLUMNS (x INT", "ALTER TABLE t ADD COLUMNS ()", "ALTER TABLE t ADD", "ALTER TABLE t RENAME", "ALTER VIEW v", "ALTER DATABASE d", "ALTER the task so that it reads more", "ALTER TABLE t SET", "ALTER TABLE t DROP", "ALTER TABLE t ALTER COLUMN", "ALTER TABLE t SET TBLPROPERTIES", "ALTER TABLE t ADD COLUMNS (x NOTATYPE)",
    "SHOW", "Show the rows of last week", "SHOW TABLES IN", "SHOW TABLES <<<<<<< HEAD", "SHOW CREATE TABLE", "SHOW COLUMNS", "SHOW COLUMNS t", "SHOW GRANT", "SHOW CURRENT", "DESCRIBE", "Describe what the load does here", "DESC t <<<<<<< HEAD", "DESC t AS JSON", "ALTER TABLE t CHANGE COLUMN a b INT", "ANALYZE TABLE t", "ANALYZE TABLE t COMPUTE", "ANALYZE the runs", "ANALYZE TABLE t COMPUTE STATISTICS FOR COLUMNS", "REFRESH", "REFRESH the table now", "Load the rows of the day", "LOAD DATA INPATH", "LOAD DATA INPATH 'x' INTO t", "LOAD DATA INPATH 'x' INTO TABLE t >>>>>>> x", "MSCK TABLE t", "REPAIR", "CLEAR", "CLEAR CACHE now",
    "ALTER banana", "SHOW BANANAS FOO", "GRANT x y z", "DESCRIBE a b c d e", "ALTER TABLE t ADD COLUMNS (a INTT,,)", "LOAD x", "ANALYZE TABLE", "EXECUTE ,,,", "DECLARE 1 2 3", "GRANT SELECT ON t TO u", "REVOKE ALL ON t FROM u", "CALL", "CALL p", "CALL p(1", "DECLARE", "DECLARE x INT DEFAULT", "EXECUTE IMMEDIATE", "EXECUTE q", "EXECUTE IMMEDIATE 'x' INTO", "EXECUTE IMMEDIATE 'x' USING",
    "SET the rows of the day", "SET a b", "SET TIME ZONE", "RESET a b", "CREATE FUNCTION", "CREATE FUNCTION f", "CREATE FUNCTION f AS", "CREATE FUNCTION f AS 'x' USING", "CREATE FUNCTION f(x) RETURN 1", "CREATE FUNCTION f(x INT) RETURNS INT", "MAP a", "MAP a USING 'x' AS", "REDUCE USING 'x'", "CREATE TABLE t (a INT) ROW FORMAT", "CREATE TABLE t (a INT) ROW FORMAT banana",
]


@pytest.fixture(scope="module")
def real(spark):
    parser = spark._jsparkSession.sessionState().sqlParser()

    def parses(sql):
        try:
            parser.parsePlan(sql)
            return True
        except Exception:
            return False

    return parses


def test_commands(real):
    for sql in GOOD:
        assert real(sql) and not parse_sql(sql), sql
    for sql in BAD:
        assert not real(sql) and parse_sql(sql), sql


def test_closing_angles_are_read_again():
    """Types that close with '>>' and are met twice, once in an alternative that fails."""
    for text in ("CREATE TABLE t (a ARRAY<ARRAY<INT>>, b MAP<STRING, ARRAY<ARRAY<INT>>>)", "SELECT CAST(a AS ARRAY<ARRAY<INT>>) AND CAST(b AS MAP<INT, ARRAY<STRUCT<x: ARRAY<INT>>>>)", "SELECT NOT (CAST(a AS ARRAY<ARRAY<INT>>) = b) FROM t", "SELECT a >> 2, b >>> 1 FROM t"):
        assert not parse_sql(text), text
    assert parse_sql("SELECT CAST(a AS ARRAY<ARRAY<INT>) FROM t")


def test_nested_alternatives_take_linear_time(real):
    """A fault below many levels that could each be read in two ways."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8000))  # as check_files does
    for form in ("NOT (", "a AND (", "a BETWEEN 1 AND (", "a BETWEEN (", "a IN (", "f(DISTINCT ", "CASE WHEN NOT (", "x LIKE (", "(SELECT ("):
        text = "SELECT " + form * 200 + "a b c d" + ")" * 200
        began = time.process_time()
        assert parse_sql(text), form
        assert time.process_time() - began < 1, form
    assert not parse_sql("SELECT " + "NOT (" * 200 + "a" + ")" * 200) and not parse_sql("SELECT " + "a AND (" * 200 + "a" + ")" * 200)


def test_mutated_commands(real):
    """The verdict is that of Spark's parser, but for odd uses of quotes in paths and of keywords as names."""
    r, wrong = random.Random(5), 0
    for _ in range(1500):
        s = r.choice(GOOD)
        k = r.randrange(len(s))
        s = r.choice([s[:k], s[:k] + s[k + 1 :], s[:k] + r.choice("(),.'x1 =<") + s[k:], s[:k] + s[k + r.randrange(1, 9) :]])
        if s.strip():
            wrong += real(s) != (not parse_sql(s))
    assert wrong <= 15
