"""Spark SQL with its default keyword rules: nearly every keyword may also be a name."""

from __future__ import annotations

import re

from loomline.llm.syntax.core import Fault, Reader, Stop, Token

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n  - 　]+|--(?:\\\n|[^\r\n])*)
|(?P<plain>[^\W\d]\w*(?!['"\w]))
|(?P<open>/\*(?!\+))
|(?P<hint>/\*\+)
|(?P<place>\{\{\s*\w+\s*\}\})
|(?P<string>[rR]'[^']*'|[rR]"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
|(?P<quoted>`(?:[^`]|``)*`)
|(?P<number>(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?:[fFdD]|[bB][dD])?(?![\w])|[0-9]+[eE][+-]?[0-9]+(?:[fFdD]|[bB][dD])?(?![\w])|[0-9]+(?:[lLsSyYfFdD]|[bB][dD])?(?![\w]))
|(?P<word>\w+)
|(?P<mark>\|>|>>>|<<|>>|<=>|<>|!=|<=|>=|==|->|=>|\|\||::|[-+*/%&|^~<>=(),.;\[\]:?!])""",
    re.X | re.S,
)
_COMMENT = re.compile(r"/\*|\*/", re.S)

# Fixed values of the Spark SQL grammar: words that can't be an alias of a table, and names of types.
_JOIN_WORDS = frozenset("ANTI CROSS EXCEPT FULL INNER INTERSECT JOIN LATERAL LEFT MINUS NATURAL ON RIGHT SEMI SETMINUS UNION USING".split()) - {"MINUS"}
_PLAIN_TYPES = frozenset(
    "BOOLEAN TINYINT BYTE SMALLINT SHORT INT INTEGER BIGINT LONG FLOAT REAL DOUBLE DATE TIME TIMESTAMP TIMESTAMP_NTZ TIMESTAMP_LTZ STRING BINARY DECIMAL DEC NUMERIC VOID INTERVAL VARIANT".split()
)
_UNITS = frozenset("YEAR YEARS QUARTER QUARTERS MONTH MONTHS WEEK WEEKS DAY DAYS HOUR HOURS MINUTE MINUTES SECOND SECONDS MILLISECOND MILLISECONDS MICROSECOND MICROSECONDS".split())
_TYPED = frozenset("DATE TIME TIMESTAMP TIMESTAMP_NTZ TIMESTAMP_LTZ X".split())

#: Words that begin a clause after a complete item, with the words one of which must follow (none: any).
_CLAUSES: dict[str, tuple[str, ...]] = {
    "FROM": (), "WHERE": (), "HAVING": (), "LIMIT": (), "OFFSET": (), "WINDOW": (), "UNION": (), "EXCEPT": (), "MINUS": (), "SETMINUS": (), "INTERSECT": (),
    "GROUP": ("BY",), "ORDER": ("BY",), "SORT": ("BY",), "CLUSTER": ("BY",), "DISTRIBUTE": ("BY",), "LATERAL": ("VIEW",),
}
#: Binding powers of binary operators.
_BINARY = {"*": 60, "/": 60, "%": 60, "DIV": 60, "+": 50, "-": 50, "||": 50, "<<": 45, ">>": 45, ">>>": 45, "&": 40, "^": 35, "|": 30} | dict.fromkeys(("=", "==", "<=>", "<>", "!=", "<", "<=", ">", ">=") , 20)
_UNARY, _PREDICATE, _NOT, _AND, _OR = 70, 15, 12, 10, 5


def _tokens(text: str) -> tuple[list[Token], int | None]:
    """Tokens, and where a comment begins that never ends."""
    out, at, open_at, size, match = [], 0, None, len(text), _TOKEN.match
    while at < size:
        m = match(text, at)
        if not m:
            out.append(Token("bad", text[at], at, text[at]))
            at += 1
            continue
        kind = m.lastgroup
        if kind == "open":
            depth, end = 1, m.end()
            while depth:
                c = _COMMENT.search(text, end)
                if not c:
                    open_at, end = at, len(text)
                    break
                depth += 1 if c.group() == "/*" else -1
                end = c.end()
            at = end
            continue
        if kind != "space":
            said = m.group()
            if kind == "plain" or kind == "word":
                out.append(Token("word", said, at, said.upper()))
            else:
                out.append(Token(kind, said, at, said))
        at = m.end()
    out.append(Token("end", "", len(text), ""))
    return out, open_at


_SETTING = re.compile(r"[a-zA-Z_\d\\.:]+(?:\s*=[^;]*)?")


class _Sql(Reader):
    def __init__(self, source: str, tokens: list[Token]):
        super().__init__(source, tokens)
        self._no_query: set[int] = set()
        self._ends: dict[int, int] = {}

    # words and marks

    def is_(self, *ups: str) -> bool:
        t = self.tokens[self.at]
        return t.up in ups and t.kind in ("word", "mark")

    def ahead(self, *ups: str) -> bool:
        return self.tokens[self.at].up == ups[0] and all(self.peek(k).up == u and self.peek(k).kind in ("word", "mark") for k, u in enumerate(ups))

    def take(self, *ups: str) -> bool:
        if self.tokens[self.at].up == ups[0] and self.ahead(*ups):
            self.at += len(ups)
            return True
        return False

    def need(self, *ups: str) -> None:
        for u in ups:
            if not self.is_(u):
                raise self.stop(u)
            self.at += 1

    def name(self) -> None:
        if self.now.kind not in ("word", "quoted"):
            raise self.stop("a name")
        if self.now.text == "``":
            raise self.stop("a name that isn't empty")
        if self.now.kind == "word" and not self.now.text.isascii():
            raise self.stop("a name of ASCII characters, or one in back quotes,")
        self.at += 1

    def names(self) -> None:
        self.name()
        while self.is_(".") and self.peek().kind in ("word", "quoted"):
            self.at += 2

    def table_name(self) -> None:
        if self.is_("IDENTIFIER") and self.ahead("IDENTIFIER", "("):
            self.at += 2
            self.expression()
            self.need(")")
        else:
            self.names()

    def name_list(self) -> None:
        self.need("(")
        self.some(self.name)
        self.need(")")

    def string(self) -> None:
        if self.now.kind != "string":
            raise self.stop("a string")
        self.at += 1

    def some(self, rule) -> None:
        rule()
        while self.is_(","):
            start = self.at
            self.at += 1
            try:
                rule()
            except Stop:
                self.at = start
                raise

    def clause_here(self) -> bool:
        t = self.now
        follow = _CLAUSES.get(t.up) if t.kind == "word" else None
        return follow is not None and (not follow or self.peek().up in follow)

    # statements

    def script(self) -> None:
        while self.now.kind != "end":
            if self.is_(";"):
                self.at += 1
                continue
            start = self.at
            self.far, self.far_message = self.at, ""
            try:
                self.statement()
                if not self.is_(";") and self.now.kind != "end":
                    raise self.stop("the end of the statement")
            except Stop:
                self.fault(self.tokens[self.far].pos, self.far_message)
                self.at = max(start, self.far)  # panic: on to the next statement
                while not self.is_(";") and self.now.kind != "end":
                    self.at += 1
            except RecursionError:
                self.fault(self.now.pos, "nested too deeply")
                while not self.is_(";") and self.now.kind != "end":
                    self.at += 1

    def statement(self) -> None:
        rule = {
            "CREATE": self.create, "REPLACE": self.create, "INSERT": self.with_ctes, "UPDATE": self.update, "DELETE": self.delete, "MERGE": self.merge, "DROP": self.drop,
            "TRUNCATE": self.truncate, "ALTER": self.alter, "SHOW": self.show, "DESCRIBE": self.describe, "DESC": self.describe, "ANALYZE": self.analyze, "REFRESH": self.refresh, "MSCK": self.repair,
            "USE": self.use, "SET": self.set_, "RESET": self.reset, "ADD": self.anything, "LIST": self.anything, "CACHE": self.cache, "UNCACHE": self.drop, "CLEAR": self.clear, "EXPLAIN": self.explain, "LOAD": self.load, "COMMENT": self.comment_on,
            "CALL": self.call_procedure, "DECLARE": self.declare, "EXECUTE": self.execute, "GRANT": self.refused, "REVOKE": self.refused, "REPAIR": self.repair,
        }.get(self.now.up if self.now.kind == "word" else "")
        if rule:
            rule()
        else:
            self.with_ctes()

    def anything(self) -> None:
        while not self.is_(";") and self.now.kind != "end":
            self.at += 1

    def refused(self) -> None:
        """Commands of other systems, which Spark takes only to refuse them."""
        raise self.stop("a command that Spark has")

    def call_procedure(self) -> None:
        self.need("CALL")
        self.table_name()
        self.need("(")
        if not self.take(")"):
            self.some(self.argument)
            self.need(")")

    def declare(self) -> None:
        self.need("DECLARE")
        self.take("OR", "REPLACE")
        if self.is_("VARIABLE", "VAR") and self.peek().kind in ("word", "quoted") and self.peek().up not in ("DEFAULT",):
            self.at += 1
        self.some(self.table_name)
        if not self.is_("DEFAULT", "="):
            self.data_type()
        if self.is_("DEFAULT", "="):
            self.at += 1
            self.expression()

    def execute(self) -> None:
        self.need("EXECUTE", "IMMEDIATE")
        self.expression()
        if self.take("INTO"):
            self.some(self.names)
        if self.take("USING"):
            if not (self.is_("(") and self.attempt(self.named_in_brackets) and self.ends()):
                self.some(self.named)

    def named_in_brackets(self) -> None:
        self.need("(")
        self.some(self.named)
        self.need(")")

    def set_(self) -> None:
        """SET, SET key, SET key = value, SET -v, SET TIME ZONE, SET VARIABLE; keys are of a few signs or in back quotes."""
        self.need("SET")
        start = self.now.pos
        if self.is_("TIME") and self.peek().up == "ZONE":
            self.at += 2
            if self.is_("LOCAL") or self.now.kind == "string":
                self.at += 1
            else:
                self.need("INTERVAL")
                self.binary(_UNARY)
                self.name()
                if self.take("TO"):
                    self.name()
        elif self.is_("VARIABLE", "VAR") and self.peek().text not in ("=", ".") and self.peek().kind != "end" and self.peek().text != ";":
            self.at += 1
            if self.is_("("):
                self.name_list()
                self.need("=", "(")
                self.query()
                self.need(")")
            else:
                self.assignments_of_set()
        elif self.now.kind == "quoted":
            self.at += 1
            if not self.ends():
                self.need("=")
                self.anything()
        else:
            first = self.at
            self.anything()
            said = self.source[start : self.now.pos].strip()
            if said and said != "-v" and not _SETTING.fullmatch(said):
                self.at = first
                raise self.stop("a key and '='")

    def assignments_of_set(self) -> None:
        def one() -> None:
            self.names()
            self.need("=")
            self.expression()

        self.some(one)

    def reset(self) -> None:
        self.need("RESET")
        start, first = self.now.pos, self.at
        quoted = self.now.kind == "quoted"
        self.anything()
        said = self.source[start : self.now.pos].strip()
        if not quoted and re.search(r"[\s`]", said):
            self.at = first
            raise self.stop("one key")

    def ends(self) -> bool:
        return self.is_(";") or self.now.kind == "end"

    def if_exists(self) -> None:
        self.take("IF", "EXISTS")

    def clear(self) -> None:
        self.need("CLEAR", "CACHE")

    def repair(self) -> None:
        self.take("MSCK")
        self.need("REPAIR", "TABLE")
        self.table_name()
        if self.is_("ADD", "DROP", "SYNC"):
            self.at += 1
            self.need("PARTITIONS")

    def load(self) -> None:
        self.need("LOAD", "DATA")
        self.take("LOCAL")
        self.need("INPATH")
        self.string()
        self.take("OVERWRITE")
        self.need("INTO", "TABLE")
        self.table_name()
        if self.is_("PARTITION"):
            self.partition_spec()

    def refresh(self) -> None:
        """A table, a function, or a path: a string, or words without a blank between them."""
        self.need("REFRESH")
        if self.is_("TABLE", "FUNCTION") and self.peek().kind in ("word", "quoted"):
            self.at += 1
            self.table_name()
        elif self.now.kind == "string" and (self.peek().kind == "end" or self.peek().text == ";"):
            self.at += 1
        else:
            if self.ends():
                raise self.stop("a path")
            while not self.ends():
                t = self.now
                if t.kind == "bad" or any(c.isspace() for c in t.text):
                    raise self.stop("a path without blanks")
                self.at += 1
                if not self.ends() and self.now.pos != t.pos + len(t.text):
                    raise self.stop("a path without blanks")

    def analyze(self) -> None:
        self.need("ANALYZE")
        if self.take("TABLES"):
            if self.is_("FROM", "IN"):
                self.at += 1
                self.table_name()
            self.need("COMPUTE", "STATISTICS")
            self.take("NOSCAN")
            return
        self.need("TABLE")
        self.table_name()
        if self.is_("PARTITION"):
            self.partition_spec()
        self.need("COMPUTE", "STATISTICS")
        if self.take("FOR"):
            if not self.take("ALL", "COLUMNS"):
                self.need("COLUMNS")
                self.some(self.name)
        else:
            self.take("NOSCAN")

    def describe(self) -> None:
        self.at += 1
        start = self.at
        for rule in (self.describe_other, self.describe_table):
            if self.attempt(rule) and self.ends():
                return
            self.at = start
        self.take("QUERY")
        self.query()

    def describe_other(self) -> None:
        if self.take("FUNCTION"):
            self.take("EXTENDED")
            if self.now.kind in ("string", "mark") and not self.is_("(", ")", ",", ".", ";", "[", "]", ":", "?"):
                self.at += 1
            else:
                self.table_name()
        elif self.take("PROCEDURE"):
            self.table_name()
        elif self.is_("DATABASE", "SCHEMA", "NAMESPACE"):
            self.at += 1
            self.take("EXTENDED")
            self.table_name()
        else:
            raise self.stop("FUNCTION or DATABASE")

    def describe_table(self) -> None:
        if self.is_("TABLE") and self.peek().kind in ("word", "quoted"):
            self.at += 1
        extended = self.is_("EXTENDED", "FORMATTED") and self.peek().kind in ("word", "quoted")
        self.at += extended
        self.table_name()
        if self.is_("PARTITION") and self.peek().text == "(":
            self.partition_spec()
        if extended and self.take("AS", "JSON"):
            return
        if not self.ends():
            self.names()

    def like(self) -> None:
        """[LIKE] 'pattern'"""
        if self.take("LIKE") or self.now.kind == "string":
            self.string()

    def within(self) -> None:
        if self.is_("FROM", "IN"):
            self.at += 1
            self.table_name()

    def show(self) -> None:
        self.need("SHOW")
        if self.is_("DATABASES", "SCHEMAS", "NAMESPACES", "TABLES", "VIEWS"):
            self.at += 1
            self.within()
            self.like()
        elif self.take("TABLE", "EXTENDED"):
            self.within()
            self.need("LIKE")
            self.string()
            if self.is_("PARTITION"):
                self.partition_spec()
        elif self.take("TBLPROPERTIES"):
            self.table_name()
            if self.take("("):
                self.string() if self.now.kind == "string" else self.names()
                self.need(")")
        elif self.take("COLUMNS"):
            if not self.is_("FROM", "IN"):
                raise self.stop("FROM or IN")
            self.within()
            self.within()
        elif self.take("PARTITIONS"):
            self.table_name()
            if self.is_("PARTITION"):
                self.partition_spec()
        elif self.take("CREATE", "TABLE"):
            self.table_name()
            self.take("AS", "SERDE")
        elif self.take("CURRENT"):
            if not self.is_("DATABASE", "SCHEMA", "NAMESPACE"):
                raise self.stop("DATABASE")
            self.at += 1
        elif self.take("CATALOGS"):
            self.like()
        elif self.take("PROCEDURES"):
            self.within()
        else:
            if not self.is_("FUNCTIONS"):
                self.name()  # USER, SYSTEM or ALL
                if self.tokens[self.at - 1].up not in ("USER", "SYSTEM", "ALL"):
                    self.at -= 1
                    raise self.stop("what to show")
            self.need("FUNCTIONS")
            self.within()
            self.take("LIKE")
            if self.now.kind == "string":
                self.at += 1
            elif not self.ends():
                self.names()

    def alter(self) -> None:
        self.need("ALTER")
        if self.is_("DATABASE", "SCHEMA", "NAMESPACE"):
            self.at += 1
            self.table_name()
            self.alter_namespace()
        elif self.take("VIEW"):
            self.table_name()
            self.alter_view()
        else:
            self.need("TABLE")
            self.table_name()
            self.alter_table()

    def alter_namespace(self) -> None:
        if self.take("UNSET"):
            if not self.is_("DBPROPERTIES", "PROPERTIES"):
                raise self.stop("PROPERTIES")
            self.at += 1
            self.properties()
            return
        if self.take("DEFAULT", "COLLATION"):
            self.name()
            return
        self.need("SET")
        if self.take("LOCATION"):
            self.string()
        elif self.is_("DBPROPERTIES", "PROPERTIES"):
            self.at += 1
            self.properties()
        else:
            raise self.stop("PROPERTIES or LOCATION")

    def alter_properties(self) -> bool:
        if self.take("SET", "TBLPROPERTIES"):
            self.properties()
        elif self.take("UNSET", "TBLPROPERTIES"):
            self.if_exists()
            self.properties()
        elif self.take("RENAME", "TO"):
            self.names()
        else:
            return False
        return True

    def alter_view(self) -> None:
        if self.alter_properties():
            return
        if self.take("WITH", "SCHEMA"):
            if not self.take("TYPE", "EVOLUTION"):
                if not self.is_("BINDING", "COMPENSATION", "EVOLUTION"):
                    raise self.stop("a kind of schema binding")
                self.at += 1
            return
        self.take("AS")
        self.query()

    def column_place(self) -> None:
        if self.take("AFTER"):
            self.name()
        else:
            self.need("FIRST")

    def new_column(self) -> None:
        self.names()
        self.data_type()
        while not self.ends() and not self.is_(",", ")"):
            if self.take("NOT", "NULL"):
                continue
            if self.take("COMMENT"):
                self.string()
            elif self.take("DEFAULT"):
                self.expression()
            else:
                self.column_place()

    def new_columns(self) -> None:
        if self.take("("):
            self.some(self.new_column)
            self.need(")")
        else:
            self.some(self.new_column)

    def changed_column(self) -> None:
        self.names()
        if self.take("TYPE"):
            self.data_type()
        elif self.take("COMMENT"):
            self.string()
        elif self.is_("FIRST", "AFTER"):
            self.column_place()
        elif self.is_("SET", "DROP"):
            drop = self.is_("DROP")
            self.at += 1
            if not self.take("NOT", "NULL"):
                self.need("DEFAULT")
                if not drop:
                    self.expression()
        else:
            raise self.stop("a change")

    def changed_columns(self) -> None:
        self.some(self.changed_column)

    def hive_column(self) -> None:
        """The old and the new name must be the same."""
        self.names()
        old = self.tokens[self.at - 1].text.strip("`").lower()
        if self.now.text.strip("`").lower() != old:
            raise self.stop("the same name")
        self.name()
        self.data_type()
        if self.take("COMMENT"):
            self.string()
        if self.is_("FIRST", "AFTER"):
            self.column_place()

    def alter_table(self) -> None:
        if self.alter_properties():
            return
        if self.take("RENAME", "COLUMN"):
            self.names()
            self.need("TO")
            self.name()
        elif self.take("ADD"):
            if self.is_("PARTITION", "IF"):
                self.if_not_exists()
                if not self.is_("PARTITION"):
                    raise self.stop("PARTITION")
                while self.is_("PARTITION"):
                    self.partition_spec()
                    if self.take("LOCATION"):
                        self.string()
            elif self.is_("COLUMN", "COLUMNS"):
                self.at += 1
                self.new_columns()
            else:
                self.constraint()
        elif self.take("DROP"):
            if self.take("CONSTRAINT"):
                self.if_exists()
                self.name()
                if self.is_("RESTRICT", "CASCADE"):
                    self.at += 1
            elif self.is_("COLUMN", "COLUMNS"):
                self.at += 1
                self.if_exists()
                if self.take("("):
                    self.some(self.names)
                    self.need(")")
                else:
                    self.some(self.names)
            else:
                self.if_exists()
                self.some(self.partition_spec)
                self.take("PURGE")
        elif self.is_("ALTER", "CHANGE"):
            self.change_column()
        elif self.take("RECOVER"):
            self.need("PARTITIONS")
        elif self.take("CLUSTER", "BY"):
            self.take("NONE") or self.name_list_of_names()
        elif self.take("DEFAULT", "COLLATION"):
            self.name()
        else:
            if self.is_("PARTITION"):
                self.partition_spec()
            if self.take("RENAME", "TO"):
                self.partition_spec()
            elif self.take("REPLACE", "COLUMNS"):
                self.need("(")
                self.some(self.new_column)
                self.need(")")
            elif self.is_("CHANGE"):
                self.change_column()
            else:
                self.need("SET")
                if self.take("LOCATION"):
                    self.string()
                elif self.take("SERDEPROPERTIES"):
                    self.properties()
                else:
                    self.need("SERDE")
                    self.string()
                    if self.take("WITH", "SERDEPROPERTIES"):
                        self.properties()

    def name_list_of_names(self) -> None:
        self.need("(")
        self.some(self.names)
        self.need(")")

    def change_column(self) -> None:
        rules = (self.changed_columns, self.hive_column) if self.is_("CHANGE") else (self.changed_columns,)
        self.at += 1
        start, word = self.at, self.is_("COLUMN")
        for skip in (word, False):  # COLUMN may be the column's name
            for rule in rules:
                self.at = start + skip
                if self.attempt(rule) and self.ends():
                    return
        self.at = start + word
        self.changed_columns()

    def use(self) -> None:
        self.need("USE")
        if self.is_("NAMESPACE", "DATABASE", "SCHEMA") and self.peek().kind in ("word", "quoted"):
            self.at += 1
        if self.now.kind == "string":
            self.at += 1
        else:
            self.table_name()

    def at_next(self) -> bool:
        self.at += 1
        return True

    def explain(self) -> None:
        self.need("EXPLAIN")
        if self.is_("EXTENDED", "CODEGEN", "COST", "FORMATTED", "LOGICAL"):
            self.at += 1
        self.statement()

    def comment_on(self) -> None:
        self.need("COMMENT", "ON")
        self.at += 1
        self.table_name()
        self.need("IS")
        if not self.take("NULL"):
            self.string()

    def cache(self) -> None:
        self.need("CACHE")
        self.take("LAZY")
        self.need("TABLE")
        self.table_name()
        if self.take("OPTIONS"):
            self.properties()
        if self.now.kind != "end" and not self.is_(";"):
            self.take("AS")
            self.query()

    def truncate(self) -> None:
        self.need("TRUNCATE", "TABLE")
        self.table_name()
        if self.is_("PARTITION"):
            self.partition_spec()

    def drop(self) -> None:
        self.at += 1
        self.take("GLOBAL")
        self.take("TEMPORARY") or self.take("TEMP")
        if not self.is_("TABLE", "VIEW", "DATABASE", "SCHEMA", "NAMESPACE", "FUNCTION", "VARIABLE"):
            raise self.stop("TABLE or VIEW")
        self.at += 1
        if self.is_("IF") and self.ahead("IF", "EXISTS"):
            self.at += 2
        self.table_name()
        if self.is_("PURGE", "RESTRICT", "CASCADE"):
            self.at += 1

    def create(self) -> None:
        if self.take("REPLACE"):
            replace = True
        else:
            self.need("CREATE")
            replace = self.take("OR", "REPLACE")
        if self.is_("TABLE"):
            self.at += 1
            if not replace:
                self.if_not_exists()
            self.table_name()
            if self.is_("LIKE") and not replace:
                self.at += 1
                self.table_name()
                return
            listed = self.is_("(") and self.attempt(self.columns)
            if self.is_("(") and not listed:
                self.query()
                return
            self.table_clauses()
            if self.now.kind != "end" and not self.is_(";"):
                if listed:
                    raise self.stop("no query after a list of columns")
                self.take("AS")
                self.query()
            return
        self.take("GLOBAL")
        temporary = self.take("TEMPORARY") or self.take("TEMP")
        if self.is_("VIEW") or self.is_("MATERIALIZED") or self.is_("METRIC"):
            self.need("VIEW")
            self.if_not_exists()
            self.table_name()
            if temporary and self.is_("USING"):
                self.at += 1
                self.names()
                if self.take("OPTIONS"):
                    self.properties()
                return
            if self.is_("("):
                self.need("(")
                self.some(self.view_column)
                self.need(")")
                if temporary and self.is_("USING"):
                    self.at += 1
                    self.names()
                    if self.take("OPTIONS"):
                        self.properties()
                    return
            while self.is_("COMMENT", "TBLPROPERTIES", "PARTITIONED", "DEFAULT", "WITH") and not self.is_("AS"):
                if self.take("COMMENT"):
                    self.string()
                elif self.take("TBLPROPERTIES"):
                    self.properties()
                elif self.take("PARTITIONED"):
                    self.need("ON")
                    self.name_list()
                elif self.take("WITH"):
                    self.need("SCHEMA")
                    self.at += 1
                else:
                    self.need("DEFAULT", "COLLATION")
                    self.name()
            self.need("AS")
            self.query()
            return
        if self.is_("DATABASE", "SCHEMA", "NAMESPACE") and not replace:
            self.at += 1
            self.if_not_exists()
            self.table_name()
            while self.is_("COMMENT", "LOCATION", "WITH"):
                if self.take("WITH"):
                    self.at += 1
                    self.properties()
                else:
                    self.at += 1
                    self.string()
            return
        if self.is_("FUNCTION"):
            self.create_function()
            return
        raise self.stop("TABLE or VIEW")

    def create_function(self) -> None:
        """A class with its resources, or parameters and a body in SQL."""
        self.need("FUNCTION")
        self.if_not_exists()
        self.table_name()
        if self.take("AS"):
            self.string()
            if self.take("USING"):
                self.some(self.resource)
            return
        self.need("(")
        if not self.take(")"):
            self.some(self.parameter)
            self.need(")")
        if self.take("RETURNS"):
            if self.is_("TABLE") and self.peek().text != "<":
                self.at += 1
                if self.take("("):
                    self.some(self.parameter)
                    self.need(")")
            else:
                self.data_type()
        while not self.is_("RETURN"):
            self.characteristic()
        self.at += 1
        if not (self.attempt(self.query) and self.ends()):
            self.expression()

    def resource(self) -> None:
        if not self.is_("JAR", "FILE", "ARCHIVE"):
            raise self.stop("JAR, FILE or ARCHIVE")
        self.at += 1
        self.string()

    def parameter(self) -> None:
        self.name()
        self.data_type()
        while not self.is_(",", ")"):
            if self.take("DEFAULT"):
                self.expression()
            elif self.take("COMMENT"):
                self.string()
            else:
                self.need("NOT", "NULL")

    def characteristic(self) -> None:
        if self.take("LANGUAGE"):
            self.name()
        elif self.take("COMMENT"):
            self.string()
        elif not (self.take("NOT", "DETERMINISTIC") or self.take("DETERMINISTIC") or self.take("CONTAINS", "SQL") or self.take("READS", "SQL", "DATA") or self.take("SQL", "SECURITY", "DEFINER") or self.take("SQL", "SECURITY", "INVOKER")):
            raise self.stop("RETURN")

    def if_not_exists(self) -> None:
        if self.ahead("IF", "NOT", "EXISTS"):
            self.at += 3

    def view_column(self) -> None:
        self.name()
        if self.take("COMMENT"):
            self.string()

    def columns(self) -> None:
        self.need("(")
        self.some(self.column)
        self.need(")")

    def column(self) -> None:
        if self.is_("CONSTRAINT", "PRIMARY", "FOREIGN", "CHECK", "UNIQUE") and self.attempt(self.constraint):
            return
        self.name()
        self.data_type()
        while True:
            if self.take("NOT", "NULL") or self.take("NULL"):
                continue
            if self.take("COMMENT"):
                self.string()
            elif self.take("DEFAULT"):
                self.expression()
            elif self.take("GENERATED"):
                self.need("ALWAYS", "AS")
                if self.take("IDENTITY"):
                    if self.is_("("):
                        self.balanced()
                else:
                    self.need("(")
                    self.expression()
                    self.need(")")
            else:
                return

    def constraint(self) -> None:
        if self.take("CONSTRAINT"):
            self.name()
        if self.take("CHECK"):
            self.need("(")
            self.expression()
            self.need(")")
        elif self.take("PRIMARY", "KEY") or self.take("UNIQUE"):
            self.name_list()
        else:
            self.need("FOREIGN", "KEY")
            self.name_list()
            self.need("REFERENCES")
            self.table_name()
            if self.is_("("):
                self.name_list()

    def balanced(self) -> None:
        depth = 0
        while True:
            if self.now.kind == "end" or self.is_(";"):
                raise self.stop("')'")
            depth += self.is_("(") - self.is_(")")
            self.at += 1
            if not depth:
                return

    def table_clauses(self) -> None:
        while True:
            if self.take("USING"):
                self.names()
            elif self.take("OPTIONS") or self.take("TBLPROPERTIES"):
                self.properties()
            elif self.take("PARTITIONED", "BY"):
                self.balanced() if self.is_("(") else self.fail("'('")
            elif self.take("CLUSTERED", "BY"):
                self.name_list()
                if self.take("SORTED", "BY"):
                    self.balanced()
                self.need("INTO")
                if self.now.kind != "number":
                    raise self.stop("a number")
                self.at += 1
                self.need("BUCKETS")
            elif self.take("CLUSTER", "BY"):
                self.name_list()
            elif self.take("LOCATION") or self.take("COMMENT"):
                self.string()
            elif self.take("STORED", "AS") or self.take("DEFAULT", "COLLATION"):
                self.name()
            elif self.ahead("ROW", "FORMAT"):
                self.row_format()
            else:
                return

    def row_format(self) -> None:
        """SERDE 'class' [WITH SERDEPROPERTIES (...)], or DELIMITED with its terminators."""
        if not self.take("ROW", "FORMAT"):
            return
        if self.take("SERDE"):
            self.string()
            if self.take("WITH", "SERDEPROPERTIES"):
                self.properties()
            return
        self.need("DELIMITED")
        if self.take("FIELDS", "TERMINATED", "BY"):
            self.string()
            if self.take("ESCAPED", "BY"):
                self.string()
        for words in (("COLLECTION", "ITEMS"), ("MAP", "KEYS"), ("LINES",)):
            if self.take(*words, "TERMINATED", "BY"):
                self.string()
        if self.take("NULL", "DEFINED", "AS"):
            self.string()

    def fail(self, wanted: str) -> None:
        raise self.stop(wanted)

    def properties(self) -> None:
        self.need("(")
        self.some(self.property_)
        self.need(")")

    def property_(self) -> None:
        self.string() if self.now.kind == "string" else self.names()
        if self.take("=") or self.take("==") or not (self.is_(",") or self.is_(")")):
            self.expression()

    def partition_spec(self) -> None:
        self.need("PARTITION", "(")
        self.some(self.partition_value)
        self.need(")")

    def partition_value(self) -> None:
        self.name()
        if self.take("=") or self.take("=="):
            self.binary(_UNARY)

    def insert(self) -> None:
        self.need("INSERT")
        if self.take("OVERWRITE"):
            if self.is_("DIRECTORY", "LOCAL"):
                self.take("LOCAL")
                self.need("DIRECTORY")
                if self.now.kind == "string":
                    self.at += 1
                if self.take("USING"):
                    self.names()
                if self.take("OPTIONS"):
                    self.properties()
                self.query()
                return
        else:
            self.need("INTO")
        if self.is_("TABLE") and self.peek().kind in ("word", "quoted") and not (self.peek().up in ("SELECT", "VALUES", "WITH", "FROM")):
            self.at += 1
        self.table_name()
        if self.take("REPLACE", "WHERE"):
            self.expression()
            self.query()
            return
        if self.is_("PARTITION"):
            self.partition_spec()
        self.if_not_exists()
        if not self.take("BY", "NAME") and self.is_("("):
            start = self.at
            if self.attempt(self.name_list):
                rest = self.at
                if self.attempt(self.query):
                    return
                self.at = rest
                far, message = self.far, self.far_message
                self.at = start
                if self.attempt(self.query):
                    return
                self.far, self.far_message = far, message
                raise Stop
        self.query()

    def update(self) -> None:
        self.need("UPDATE")
        self.table_name()
        if not (self.is_("SET") and self.attempt(self.assignments)):
            self.table_alias("SET")
            self.assignments()
        if self.take("WHERE"):
            self.expression()

    def assignments(self) -> None:
        self.need("SET")
        self.some(self.assignment)

    def assignment(self) -> None:
        self.names()
        if not (self.take("=") or self.take("==")):
            raise self.stop("'='")
        self.expression()

    def delete(self) -> None:
        self.need("DELETE", "FROM")
        self.table_name()
        self.table_alias()
        if self.take("WHERE"):
            self.expression()

    def merge(self) -> None:
        self.need("MERGE")
        self.take("WITH", "SCHEMA", "EVOLUTION")
        self.need("INTO")
        self.table_name()
        self.table_alias("USING")
        self.need("USING")
        if self.is_("("):
            self.need("(")
            self.query()
            self.need(")")
        else:
            self.table_name()
        self.table_alias()
        self.need("ON")
        self.expression()
        if not self.is_("WHEN"):
            raise self.stop("WHEN")
        while self.take("WHEN"):
            kind = "MATCHED"
            if self.take("NOT", "MATCHED"):
                kind = "NOT"
                if self.take("BY", "SOURCE"):
                    kind = "SOURCE"
                else:
                    self.take("BY", "TARGET")
            else:
                self.need("MATCHED")
            if self.take("AND"):
                self.expression()
            self.need("THEN")
            if kind == "NOT":
                self.need("INSERT")
                if not self.take("*"):
                    self.need("(")
                    self.some(self.names)
                    self.need(")", "VALUES", "(")
                    self.some(self.expression)
                    self.need(")")
            elif not self.take("DELETE"):
                self.need("UPDATE", "SET")
                if not self.take("*"):
                    self.some(self.assignment)

    def with_ctes(self) -> None:
        if self.is_("WITH"):
            self.ctes()
        if self.is_("INSERT"):
            self.insert()
        elif self.is_("FROM") and self.attempt(self.from_inserts):
            pass
        elif self.is_("UPDATE"):
            self.update()
        elif self.is_("DELETE"):
            self.delete()
        elif self.is_("MERGE"):
            self.merge()
        else:
            self.query(False)

    def from_inserts(self) -> None:
        self.from_clause()
        if not self.is_("INSERT"):
            raise Stop
        while self.is_("INSERT"):
            self.need("INSERT")
            self.take("OVERWRITE") or self.need("INTO")
            self.take("TABLE")
            self.table_name()
            self.select_core()
            self.query_tail()

    # queries

    def ctes(self) -> None:
        self.need("WITH")
        self.take("RECURSIVE")
        self.some(self.cte)

    def cte(self) -> None:
        self.name()
        if self.is_("(") and not self.attempt(self.cte_body):
            self.name_list()
        elif self.tokens[self.at - 1].up == ")":
            return
        if self.take("MAX"):
            self.need("RECURSION", "LEVEL")
            self.at += 1
        self.cte_body()

    def cte_body(self) -> None:
        self.take("AS")
        self.need("(")
        self.query()
        self.need(")")

    def query(self, ctes: bool = True) -> None:
        if ctes and self.is_("WITH"):
            self.ctes()
        self.terms()
        self.query_tail()

    def terms(self) -> None:
        self.primary_query()
        while True:
            if self.is_("UNION", "EXCEPT", "MINUS", "SETMINUS", "INTERSECT"):
                self.at += 1
                self.take("ALL") or self.take("DISTINCT")
                self.primary_query()
            elif self.is_("|>"):
                self.at += 1
                self.pipe()
            else:
                return

    def pipe(self) -> None:
        if self.is_("SELECT"):
            self.select_list()
            if self.is_("WINDOW"):
                self.window_clause()
        elif self.take("EXTEND"):
            self.some(self.named)
        elif self.take("SET"):
            self.some(self.assignment)
        elif self.take("DROP"):
            self.some(self.name)
        elif self.take("AS"):
            self.name()
        elif self.take("WHERE"):
            self.expression()
        elif self.take("AGGREGATE"):
            if not (self.is_("GROUP") and self.ahead("GROUP", "BY")):
                self.some(self.named)
            if self.take("GROUP", "BY"):
                self.some(self.named)
        elif self.is_("UNION", "EXCEPT", "MINUS", "SETMINUS", "INTERSECT"):
            self.at += 1
            self.take("ALL") or self.take("DISTINCT")
            self.primary_query()
        elif self.is_("PIVOT"):
            self.pivot()
        elif self.is_("UNPIVOT"):
            self.unpivot()
        elif self.is_("TABLESAMPLE"):
            self.sample()
        elif not self.join():
            start = self.at
            self.query_tail()
            if self.at == start:
                raise self.stop("an operator after '|>'")

    def parenthesised_query(self) -> None:
        if self.at in self._no_query:
            raise Stop
        start = self.at
        try:
            self.need("(")
            self.query()
            self.need(")")
        except Stop:
            self._no_query.add(start)
            raise

    def primary_query(self) -> None:
        if self.is_("("):
            self.parenthesised_query()
        elif self.is_("SELECT"):
            self.select_core()
        elif self.is_("FROM"):
            self.from_clause()
            if self.is_("SELECT"):
                while self.is_("SELECT"):
                    self.select_core()
            elif not self.is_("|>", ";", ")") and self.now.kind != "end" and not self.clause_here():
                raise self.stop("SELECT")
        elif self.is_("VALUES"):
            self.values()
        elif self.is_("TABLE"):
            self.at += 1
            self.table_name()
        elif self.is_("MAP", "REDUCE"):
            self.at += 1
            self.some(self.expression)
            self.through_script()
            if self.is_("FROM"):
                self.from_clause()
        else:
            raise self.stop("a query")

    def through_script(self) -> None:
        """[ROW FORMAT ...] USING 'command' [AS columns] [ROW FORMAT ...]"""
        self.row_format()
        self.need("USING")
        self.string()
        if self.take("AS"):
            if self.is_("("):
                self.need("(")
                self.some(self.maybe_typed)
                self.need(")")
            else:
                self.some(self.maybe_typed)
        self.row_format()

    def transform(self) -> None:
        self.need("SELECT", "TRANSFORM", "(")
        self.some(self.expression)
        self.need(")")
        self.through_script()

    def maybe_typed(self) -> None:
        self.name()
        if not (self.is_(",", ")", "FROM", "ROW") or self.ends()):
            self.data_type()

    def values(self) -> None:
        self.need("VALUES")
        self.some(self.expression)
        self.table_alias()

    def select_list(self) -> None:
        self.need("SELECT")
        while self.now.kind == "hint":
            while self.now.kind != "end" and not (self.is_("*") and self.peek().text == "/"):
                self.at += 1
            if self.now.kind == "end":
                raise self.stop("the end of the hint")
            self.at += 2
        if self.is_("DISTINCT", "ALL"):
            start = self.at
            self.at += 1
            if self.attempt(self.some, self.named):
                return
            self.at = start
        self.some(self.named)

    def select_core(self) -> None:
        if not (self.ahead("SELECT", "TRANSFORM", "(") and self.attempt(self.transform)):
            self.select_list()
        if self.is_("FROM"):
            self.from_clause()
        while self.is_("LATERAL") and self.ahead("LATERAL", "VIEW"):
            self.lateral_view()
        if self.take("WHERE"):
            self.expression()
        if self.take("GROUP", "BY"):
            self.group_by()
        if self.take("HAVING"):
            self.expression()
        if self.is_("WINDOW"):
            self.attempt(self.window_clause)

    def named(self) -> None:
        """An expression with an optional alias, for which AS itself will do if no name follows it."""
        self.expression()
        if self.take("AS"):
            if self.is_("("):
                self.name_list()
            elif self.now.kind == "quoted" or self.now.kind == "word" and not (self.clause_here() and self.clause_follows()):
                self.name()
        elif self.now.kind == "quoted" or self.now.kind == "word" and not (self.clause_here() and self.clause_follows()):
            self.name()
        elif self.is_("("):
            self.attempt(self.name_list)

    def clause_follows(self) -> bool:
        """Whether the clause word here can be one: FROM needs a relation after it, and so on."""
        n = self.peek()
        if n.kind == "end" or n.kind == "mark" and n.text in (",", ";", ")", "."):
            return False
        return not (self.is_("FROM") and n.kind == "word" and (n.up == "WHERE" or n.up in ("GROUP", "ORDER") and self.peek(2).up == "BY"))

    def from_clause(self) -> None:
        self.need("FROM")
        self.some(self.relation)
        while self.is_("LATERAL") and self.ahead("LATERAL", "VIEW"):
            self.lateral_view()
        if self.is_("PIVOT"):
            self.attempt(self.pivot)
        elif self.is_("UNPIVOT"):
            self.attempt(self.unpivot)

    def relation(self) -> None:
        self.take("LATERAL")
        self.relation_primary()
        while True:
            if self.is_("PIVOT") and self.attempt(self.pivot) or self.is_("UNPIVOT") and self.attempt(self.unpivot):
                continue
            if not self.join():
                return

    def join(self) -> bool:
        """One join, if one begins here."""
        k = self.at
        natural = self.take("NATURAL")
        if self.take("INNER") or self.take("CROSS"):
            pass
        elif self.is_("LEFT", "RIGHT", "FULL"):
            left = self.is_("LEFT")
            self.at += 1
            if not self.take("OUTER") and left:
                self.take("SEMI") or self.take("ANTI")
        else:
            self.take("SEMI") or self.take("ANTI")
        if not self.is_("JOIN"):
            if self.at != k:
                stop = self.stop("JOIN")
                self.at = k
                raise stop
            return False
        self.at += 1
        self.take("LATERAL")
        self.relation_primary()
        if natural:
            return True
        if self.take("ON"):
            self.expression()
        elif self.take("USING"):
            self.name_list()
        return True

    def relation_primary(self) -> None:
        if self.is_("("):
            if not self.attempt(self.parenthesised_query):
                self.need("(")
                self.relation()
                self.need(")")
            self.sample(True)
            self.table_alias()
        elif self.is_("VALUES") and self.attempt(self.values):
            pass
        elif self.now.kind in ("word", "quoted") and not (self.is_("IDENTIFIER") and self.ahead("IDENTIFIER", "(")):
            self.names()
            if self.is_("("):
                self.at += 1
                if not self.is_(")"):
                    self.some(self.table_argument)
                self.need(")")
                if self.take("WITH", "ORDINALITY"):
                    pass
                self.table_alias()
                return
            if self.is_("FOR", "TIMESTAMP", "SYSTEM_TIMESTAMP", "VERSION", "SYSTEM_VERSION"):
                self.attempt(self.time_travel)
            self.sample(True)
            self.table_alias()
        elif self.is_("IDENTIFIER"):
            self.table_name()
            self.sample(True)
            self.table_alias()
        else:
            raise self.stop("a table")

    def time_travel(self) -> None:
        self.take("FOR")
        if not self.is_("TIMESTAMP", "SYSTEM_TIMESTAMP", "SYSTEM_TIME", "VERSION", "SYSTEM_VERSION"):
            raise Stop
        self.at += 1
        self.need("AS", "OF")
        self.binary(_UNARY)

    def table_argument(self) -> None:
        if self.is_("TABLE") and self.attempt(self.table_as_argument):
            return
        self.argument()

    def table_as_argument(self) -> None:
        self.need("TABLE")
        if self.is_("("):
            self.need("(")
            if not self.attempt(self.query):
                self.table_name()
            self.need(")")
        else:
            self.table_name()
        if self.is_("PARTITION", "DISTRIBUTE"):
            self.at += 1
            self.need("BY")
            if self.is_("("):
                self.balanced()
            else:
                self.expression()
        if self.is_("ORDER", "SORT"):
            self.at += 1
            self.need("BY")
            if self.is_("("):
                self.balanced()
            else:
                self.sort_item()

    def sample(self, optional: bool = False) -> None:
        if not (self.is_("TABLESAMPLE") and (self.ahead("TABLESAMPLE", "(") or self.ahead("TABLESAMPLE", "REPEATABLE") or self.ahead("TABLESAMPLE", "SYSTEM") or self.ahead("TABLESAMPLE", "BERNOULLI"))):
            if optional:
                return
            raise self.stop("TABLESAMPLE")
        self.at += 1
        self.take("SYSTEM") or self.take("BERNOULLI")
        self.need("(")
        if self.take("BUCKET"):
            while not self.is_(")"):
                if self.now.kind == "end":
                    raise self.stop("')'")
                self.at += 1
        else:
            self.binary(_UNARY)
            if self.is_("PERCENT", "ROWS"):
                self.at += 1
        self.need(")")
        if self.take("REPEATABLE"):
            self.need("(")
            self.at += 1
            self.need(")")

    def table_alias(self, *but: str) -> None:
        if self.is_("AS"):
            self.at += 1
            if self.now.kind == "quoted" or self.now.kind == "word" and self.now.up not in _JOIN_WORDS and not (self.clause_here() and self.clause_follows()):
                self.name()
        elif self.now.kind == "quoted":
            self.name()
        elif self.now.kind == "word" and self.now.up not in _JOIN_WORDS and self.now.up not in but and not self.clause_here() and not self.other_clause():
            self.name()
        else:
            return
        if self.is_("("):
            self.attempt(self.name_list)

    def other_clause(self) -> bool:
        t, n = self.now.up, self.peek()
        return (
            t in ("PIVOT", "UNPIVOT") and n.text == "("
            or t == "UNPIVOT" and n.up in ("INCLUDE", "EXCLUDE")
            or t in ("WHEN", "INSERT", "SELECT") and n.kind != "end"
            or t == "TABLESAMPLE"
        )

    def lateral_view(self) -> None:
        self.need("LATERAL", "VIEW")
        if self.is_("OUTER") and self.peek().text != "(":
            self.at += 1
        self.names()
        self.need("(")
        if not self.is_(")"):
            self.some(self.expression)
        self.need(")")
        # table name, then AS and column names, all of them optional but the first
        self.name()
        if self.take("AS"):
            self.some(self.name)
        elif self.now.kind == "word" and not self.clause_here() and not self.is_("LATERAL", "PIVOT") or self.now.kind == "quoted":
            self.some(self.name)

    def pivot(self) -> None:
        self.need("PIVOT", "(")
        self.some(self.named_for)
        self.need("FOR")
        if self.is_("("):
            self.name_list()
        else:
            self.name()
        self.need("IN", "(")
        self.some(self.named)
        self.need(")", ")")

    def named_for(self) -> None:
        self.expression()
        if self.take("AS"):
            self.name()
        elif self.now.kind in ("word", "quoted") and not self.is_("FOR"):
            self.at += 1

    def unpivot(self) -> None:
        self.need("UNPIVOT")
        if self.is_("INCLUDE", "EXCLUDE"):
            self.at += 1
            self.need("NULLS")
        self.need("(")
        if self.is_("("):
            self.name_list()
        else:
            self.name()
        self.need("FOR")
        self.name()
        self.need("IN", "(")
        self.some(self.unpivot_column)
        self.need(")", ")")
        self.table_alias()

    def unpivot_column(self) -> None:
        if self.is_("("):
            self.need("(")
            self.some(self.names)
            self.need(")")
        else:
            self.names()
        if self.take("AS"):
            self.name()
        elif self.now.kind in ("word", "quoted"):
            self.at += 1

    def group_by(self) -> None:
        self.some(self.grouping)
        if self.take("WITH"):
            if not (self.take("CUBE") or self.take("ROLLUP")):
                raise self.stop("CUBE or ROLLUP")
        elif self.is_("GROUPING") and self.ahead("GROUPING", "SETS"):
            self.at += 2
            self.need("(")
            self.some(self.grouping_set)
            self.need(")")

    def grouping(self) -> None:
        if self.ahead("GROUPING", "SETS", "("):
            self.at += 3
            self.some(self.grouping)
            self.need(")")
        elif self.is_("ROLLUP", "CUBE") and self.peek().text == "(":
            self.at += 1
            self.need("(")
            self.some(self.grouping_set)
            self.need(")")
        elif self.is_("(") and self.ahead("(", ")"):
            self.at += 2
        else:
            self.expression()

    def grouping_set(self) -> None:
        if self.is_("(") and self.ahead("(", ")"):
            self.at += 2
        else:
            self.expression()

    def window_clause(self) -> None:
        self.need("WINDOW")
        self.some(self.named_window)

    def named_window(self) -> None:
        self.name()
        self.need("AS")
        self.window_spec()

    def query_tail(self) -> None:
        if self.take("ORDER", "BY"):
            self.some(self.sort_item)
        if self.take("CLUSTER", "BY"):
            self.some(self.expression)
        if self.take("DISTRIBUTE", "BY"):
            self.some(self.expression)
        if self.take("SORT", "BY"):
            self.some(self.sort_item)
        if self.is_("WINDOW"):
            self.window_clause()
        if self.take("LIMIT"):
            if not (self.is_("ALL") and self.at_next()):
                self.expression()
        if self.take("OFFSET"):
            self.expression()

    def sort_item(self) -> None:
        self.expression()
        self.take("ASC") or self.take("DESC")
        if self.take("NULLS"):
            if not (self.take("FIRST") or self.take("LAST")):
                raise self.stop("FIRST or LAST")

    # expressions

    def expression(self) -> None:
        self.binary(0)

    def binary(self, least: int) -> None:
        """Once for each place and power, as `once` does for rules that are tried."""
        key = self.at << 7 | least
        end = self._ends.get(key)
        if end is None:
            try:
                self._binary(least)
            except Stop:
                self._ends[key] = -1
                raise
            self._ends[key] = self.at
        elif end < 0:
            raise Stop
        else:
            self.at = end

    def _binary(self, least: int) -> None:
        """Precedence climbing. An operator that is a word and whose right side fails is left for others to use."""
        t = self.now
        if (t.up == "NOT" and t.kind == "word" or t.text == "!") and least <= _NOT:
            if not (t.up == "NOT" and not self.attempt(self._after_not)):
                if t.text == "!":
                    self.at += 1
                    self.binary(_NOT)
            else:
                self.primary()
        elif t.text in ("-", "+", "~") and t.kind == "mark":
            self.at += 1
            self.binary(_UNARY)
        else:
            self.primary()
        self.rest(least)

    def _after_not(self) -> None:
        self.need("NOT")
        self.binary(_NOT)

    def rest(self, least: int) -> None:
        predicated = False
        while True:
            t = self.now
            if t.kind == "word":
                power = {"AND": _AND, "OR": _OR, "DIV": 60}.get(t.up)
                if power is None:
                    if predicated or least > _PREDICATE or t.up not in ("IS", "IN", "BETWEEN", "LIKE", "ILIKE", "RLIKE", "REGEXP", "NOT"):
                        return
                    if not self.attempt(self.predicate):
                        return
                    predicated = True
                    continue
                if power < least or not self.attempt(self._word_operator, power):
                    return
                predicated = predicated and power > _PREDICATE
            elif t.kind == "mark":
                power = _BINARY.get(t.text)
                if power is None or power < least or predicated:
                    return
                self.at += 1
                self.binary(power + 1)
            else:
                return

    def _word_operator(self, power: int) -> None:
        self.at += 1
        self.binary(power + 1)

    def predicate(self) -> None:
        if self.take("IS"):
            self.take("NOT")
            if self.is_("NULL", "TRUE", "FALSE", "UNKNOWN"):
                self.at += 1
            else:
                self.need("DISTINCT", "FROM")
                self.binary(_PREDICATE + 1)
            return
        self.take("NOT")
        if self.take("BETWEEN"):
            self.binary(_PREDICATE + 1)
            self.need("AND")
            self.binary(_PREDICATE + 1)
        elif self.take("IN"):
            if not self.attempt(self.parenthesised_query):
                self.need("(")
                self.some(self.expression)
                self.need(")")
        elif self.is_("LIKE", "ILIKE"):
            self.at += 1
            if self.is_("ANY", "SOME", "ALL") and self.peek().text == "(":
                self.at += 1
                self.need("(")
                if not self.is_(")"):
                    self.some(self.expression)
                self.need(")")
            else:
                self.binary(_PREDICATE + 1)
                if self.take("ESCAPE"):
                    if len(self.now.text) != 3 and self.now.text not in ("'\\\\'", '"\\\\"'):
                        raise self.stop("one character")
                    self.string()
        elif self.is_("RLIKE", "REGEXP"):
            self.at += 1
            self.binary(_PREDICATE + 1)
        else:
            raise self.stop("a predicate")

    def primary(self) -> None:
        t = self.now
        if t.kind == "word":
            special = self._special.get(t.up)
            if not (special and self.attempt(special, self)):
                self.column_or_call()
        elif t.kind == "quoted":
            self.column_or_call()
        elif t.kind in ("number", "place"):
            self.at += 1
        elif t.kind == "string":
            while self.now.kind == "string":
                self.at += 1
        elif t.text == "*":
            self.at += 1
            self.star_tail()
        elif t.text == "(":
            self.bracketed()
        elif t.text == "?":
            self.at += 1
        elif t.text == ":":
            self.at += 1
            self.name()
        else:
            raise self.stop("an expression")
        while True:
            if self.is_("["):
                self.at += 1
                self.expression()
                self.need("]")
            elif self.is_("."):
                if self.peek().text == "*":
                    self.at += 2
                    self.star_tail()
                else:
                    self.at += 1
                    self.name()
            elif self.is_("::"):
                self.at += 1
                self.data_type()
            elif self.is_("COLLATE") and self.peek().kind in ("word", "quoted"):
                self.at += 1
                self.names()
            else:
                return

    def star_tail(self) -> None:
        if self.is_("EXCEPT") and self.peek().text == "(":
            self.at += 1
            self.need("(")
            self.some(self.names)
            self.need(")")

    def bracketed(self) -> None:
        if self.peek().up in ("SELECT", "WITH", "FROM", "VALUES", "TABLE", "(", "MAP", "REDUCE") and self.attempt(self.parenthesised_query):
            return
        if self.peek().kind in ("word", "quoted") and self.attempt(self.lambda_):
            return
        self.need("(")
        start = self.at
        self.expression()
        if not self.is_(")"):
            self.at = start
            self.named()
            if not self.is_(","):
                raise self.stop("',' or ')'")
            self.at += 1
            self.some(self.named)
        self.need(")")

    def lambda_(self) -> None:
        self.name_list()
        self.need("->")
        self.expression()

    def column_or_call(self) -> None:
        t = self.now
        self.name()
        if t.kind == "word" and self.now.kind == "string":
            if t.up in _TYPED and (t.up != "X" or re.fullmatch("[0-9a-fA-F]*", self.now.text[1:-1])):
                self.at += 1
                return
            raise self.stop("no string")
        if self.is_("->"):
            self.at += 1
            self.expression()
            return
        while self.is_(".") and self.peek().kind in ("word", "quoted"):
            self.at += 2
        if self.is_("("):
            self.call()

    def call(self) -> None:
        self.need("(")
        if not self.take(")"):
            if self.is_("DISTINCT", "ALL"):
                start = self.at
                self.at += 1
                if not self.attempt(self.arguments):
                    self.at = start
                    self.arguments()
            else:
                self.arguments()
        if self.take("WITHIN", "GROUP"):
            self.need("(", "ORDER", "BY")
            self.some(self.sort_item)
            self.need(")")
        if self.is_("FILTER") and self.peek().text == "(":
            self.attempt(self.filter_)
        if (self.is_("IGNORE") or self.is_("RESPECT")) and self.peek().up == "NULLS":
            self.at += 2
        if self.is_("OVER"):
            self.attempt(self.over)

    def filter_(self) -> None:
        self.need("FILTER", "(", "WHERE")
        self.expression()
        self.need(")")

    def arguments(self) -> None:
        self.some(self.argument)
        self.need(")")

    def argument(self) -> None:
        if self.now.kind in ("word", "quoted") and self.peek().text == "=>":
            self.at += 2
        self.expression()
        if self.ahead("IGNORE", "NULLS") or self.ahead("RESPECT", "NULLS"):
            self.at += 2

    def over(self) -> None:
        self.need("OVER")
        self.window_spec()

    def window_spec(self) -> None:
        if not self.is_("("):
            self.name()
            return
        if self.peek().kind in ("word", "quoted") and self.peek(2).text == ")":
            self.at += 3
            return
        self.need("(")
        if self.take("CLUSTER", "BY"):
            self.some(self.expression)
        else:
            if self.take("PARTITION", "BY") or self.take("DISTRIBUTE", "BY"):
                self.some(self.expression)
            if self.take("ORDER", "BY") or self.take("SORT", "BY"):
                self.some(self.sort_item)
        if self.is_("ROWS", "RANGE"):
            self.at += 1
            if self.take("BETWEEN"):
                self.bound()
                self.need("AND")
            self.bound()
        self.need(")")

    def bound(self) -> None:
        if self.is_("UNBOUNDED") and self.peek().up in ("PRECEDING", "FOLLOWING"):
            self.at += 2
        elif self.ahead("CURRENT", "ROW"):
            self.at += 2
        else:
            self.expression()
            if not (self.take("PRECEDING") or self.take("FOLLOWING")):
                raise self.stop("PRECEDING or FOLLOWING")

    # expressions that begin with a word of their own

    def case(self) -> None:
        self.need("CASE")
        if not self.is_("WHEN"):
            self.expression()
        while True:
            self.need("WHEN")
            self.expression()
            self.need("THEN")
            self.expression()
            if not self.is_("WHEN"):
                break
        if self.take("ELSE"):
            self.expression()
        self.need("END")

    def cast(self) -> None:
        self.at += 1
        self.need("(")
        self.expression()
        self.need("AS")
        self.data_type()
        self.need(")")

    def exists(self) -> None:
        self.need("EXISTS")
        self.parenthesised_query()

    def interval(self) -> None:
        self.need("INTERVAL")
        if self.now.kind == "string" and self.peek().up not in _UNITS:
            self.at += 1
            return
        k = 0
        while self.is_("-", "+") or self.now.kind in ("number", "string", "place") or self.is_("("):
            if self.is_("-", "+"):
                self.at += 1
            self.primary()
            if self.now.up not in _UNITS or self.now.kind != "word":
                raise self.stop("a unit of time")
            self.at += 1
            k += 1
            if self.take("TO"):
                self.at += 1
                return
        if not k:
            raise self.stop("an interval")

    def extract(self) -> None:
        self.need("EXTRACT", "(")
        self.name()
        self.need("FROM")
        self.binary(_PREDICATE + 1)
        self.need(")")

    def trim(self) -> None:
        self.need("TRIM", "(")
        if self.is_("BOTH", "LEADING", "TRAILING"):
            self.at += 1
        if not self.is_("FROM"):
            self.binary(_PREDICATE + 1)
        self.need("FROM")
        self.binary(_PREDICATE + 1)
        self.need(")")

    def substring(self) -> None:
        self.at += 1
        self.need("(")
        self.binary(_PREDICATE + 1)
        self.need("FROM")
        self.binary(_PREDICATE + 1)
        if self.take("FOR"):
            self.binary(_PREDICATE + 1)
        self.need(")")

    def position(self) -> None:
        self.need("POSITION", "(")
        self.binary(_PREDICATE + 1)
        self.need("IN")
        self.binary(_PREDICATE + 1)
        self.need(")")

    def overlay(self) -> None:
        self.need("OVERLAY", "(")
        self.binary(_PREDICATE + 1)
        self.need("PLACING")
        self.binary(_PREDICATE + 1)
        self.need("FROM")
        self.binary(_PREDICATE + 1)
        if self.take("FOR"):
            self.binary(_PREDICATE + 1)
        self.need(")")

    def struct(self) -> None:
        self.need("STRUCT", "(")
        if not self.is_(")"):
            self.some(self.named)
        self.need(")")

    def date_add(self) -> None:
        self.at += 1
        self.need("(")
        if self.now.up not in _UNITS or self.peek().text != ",":
            raise Stop
        self.at += 2
        self.expression()
        self.need(",")
        self.expression()
        self.need(")")

    def constant(self) -> None:
        if self.peek().text in (".", "("):
            raise Stop
        self.at += 1

    _special = {
        "CASE": case, "CAST": cast, "TRY_CAST": cast, "EXISTS": exists, "INTERVAL": interval, "EXTRACT": extract, "TRIM": trim, "SUBSTR": substring, "SUBSTRING": substring, "POSITION": position,
        "OVERLAY": overlay, "STRUCT": struct, "TIMESTAMPADD": date_add, "TIMESTAMPDIFF": date_add, "DATEADD": date_add, "DATE_ADD": date_add, "DATEDIFF": date_add, "DATE_DIFF": date_add,
        "NULL": constant, "TRUE": constant, "FALSE": constant,
    }

    def data_type(self) -> None:
        t = self.now
        if t.kind != "word":
            raise self.stop("a type")
        if t.up in ("ARRAY", "MAP", "STRUCT") and self.peek().text in ("<", "<>"):
            self.at += 1
            if self.now.text == "<>":
                if t.up != "STRUCT":
                    raise self.stop("a type")
                self.at += 1
                return
            self.at += 1
            if t.up == "STRUCT":
                if not self.is_(">"):
                    self.some(self.field)
            else:
                self.data_type()
                if t.up == "MAP":
                    self.need(",")
                    self.data_type()
            self.close_angle()
        elif t.up in ("CHAR", "CHARACTER", "VARCHAR"):
            self.at += 1
            self.need("(")
            self.number()
            self.need(")")
        elif t.up == "INTERVAL":
            self.at += 1
            if self.now.up in _UNITS and self.now.kind == "word":
                self.at += 1
                if self.take("TO"):
                    self.at += 1
        elif t.up in _PLAIN_TYPES:
            self.at += 1
            if t.up in ("DECIMAL", "DEC", "NUMERIC", "TIME") and self.is_("("):
                self.at += 1
                self.number()
                if self.take(","):
                    self.number()
                self.need(")")
            if t.up in ("TIMESTAMP", "TIME") and (self.ahead("WITHOUT", "TIME", "ZONE") or self.ahead("WITH", "LOCAL", "TIME")):
                self.at += 3
                self.take("ZONE")
            if t.up == "STRING" and self.take("COLLATE"):
                self.names()
        else:
            raise self.stop("a type")

    def number(self) -> None:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise self.stop("a number")
        self.at += 1

    def field(self) -> None:
        self.name()
        self.take(":")
        self.data_type()
        self.take("NOT", "NULL")
        if self.take("COMMENT"):
            self.string()

    def close_angle(self) -> None:
        """'>>' closes two types."""
        t = self.now
        if t.text in (">", ">>", ">>>"):
            if t.text == ">":
                self.at += 1
            else:
                rest = t.text[1:]
                self.tokens[self.at : self.at + 1] = [Token("mark", ">", t.pos, ">"), Token("mark", rest, t.pos + 1, rest)]
                self.known.clear()  # places after this one have moved
                self._ends.clear()
                self.at += 1
        else:
            raise self.stop("'>'")


def parse_sql(text: str) -> list[Fault]:
    """Faults of a script of statements parted by semicolons; {{ name }} stands for a literal.

    A text of blanks and comments alone has none.
    """
    tokens, open_at = _tokens(text)
    p = _Sql(text, tokens)
    p.script()
    if open_at is not None:
        p.fault(open_at, "a comment that doesn't end")
    p.known.clear()  # its keys may hold p
    return p.faults
