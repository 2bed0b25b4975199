"""Queries of other SQL dialects as Spark SQL.

A statement is parsed to its token tree and rewritten clause by clause; what Spark already accepts passes unchanged.
Forms that need an operator of this package instead of a text (ASOF, POSITIONAL, MATCH_RECOGNIZE ..) are refused by name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from arborlake.functions.scalars import FUNCTION_NAMES
from arborlake.functions.types import UnknownType, spark_type
from arborlake.sources.readers import FORMATS
from arborlake.syntax.nodes import Node
from arborlake.syntax.sql import DIALECTS, Options, parse_sql
from arborlake.syntax.sql_tree import parse_sql_tree

CLAUSES = ("select", "from", "where", "group", "having", "qualify", "window", "order", "limit", "offset", "fetch")
SETS = ("union", "intersect", "except", "minus")
OPERATORS = {"asof": "operators.joins.asof_join", "positional": "operators.joins.positional_join", "match_recognize": "operators.patterns.match_recognize", "nearest": "operators.joins.nearest_value"}
#: Names that Spark knows itself and FUNCTION_NAMES would change.
OWN = frozenset("range length instr substr isnull ifnull nvl regexp_extract to_char datediff dateadd".split())


class NotRewritten(ValueError):
    """A form that a text can't express; the message names the operator that does it."""


class _Rewriter:
    def __init__(self, source: bytes):
        self.source = source

    def text(self, n: Node) -> str:
        return self.source[n.start : n.end].decode("utf-8")

    def word(self, n: Node | None) -> str:
        return self.text(n).lower() if n is not None and n.kind in ("keyword", "identifier") else ""

    def tokens(self, nodes: list[Node]) -> list[Node]:
        return [n for n in nodes if n.kind != "comment" and not (n.missing and not n.children)]

    # -- expressions

    def expression(self, nodes: list[Node]) -> str:
        out: list[str] = []
        k = 0
        while k < len(nodes):
            n, nxt = nodes[k], nodes[k + 1] if k + 1 < len(nodes) else None
            w = self.word(n)
            if n.kind == "parenthesis":
                out.append(self.bracket(n, before=self.word(nodes[k - 1]) if k else "", indexed=bool(k) and (nodes[k - 1].kind in ("identifier", "quoted_identifier", "parenthesis") and self.word(nodes[k - 1]) not in ("in", "array"))))
            elif n.kind == "quoted_identifier":
                out.append("`" + self.text(n)[1:-1].replace('""', '"').replace("`", "``") + "`")
            elif n.kind == "string":
                out.append(self.string(self.text(n)))
            elif w == "exclude":
                out.append("EXCEPT")
            elif w in OPERATORS and nxt is not None and (self.word(nxt) in ("join", "left", "inner") or nxt.kind == "parenthesis"):
                raise NotRewritten(f"{w}: use {OPERATORS[w]}")
            elif w in ("semi", "anti") and self.word(nxt) == "join" and (not k or self.word(nodes[k - 1]) not in ("left", "right")):
                out.append("LEFT " + w.upper())
            elif n.kind == "identifier" and nxt is not None and nxt.kind == "parenthesis" and self.text(nxt).startswith("(") and w in {x.lower() for x in FUNCTION_NAMES} and w not in OWN and not (k and self.text(nodes[k - 1]) == "."):
                out.append({x.lower(): y for x, y in FUNCTION_NAMES.items()}[w])
            else:
                out.append(self.text(n))
            k += 1
        return self.joined(nodes, out)

    def joined(self, nodes: list[Node], out: list[str]) -> str:
        """The pieces with the white space between their tokens kept as one space or none."""
        text = ""
        for k, piece in enumerate(out):
            if k and self.source[nodes[k - 1].end : nodes[k].start].strip(b"\x00") != b"":
                text += " "
            text += piece
        return text

    def string(self, s: str) -> str:
        return s if s[0] in "'xX" else "'" + s[s.index("'") + 1 :]

    def bracket(self, n: Node, before: str, indexed: bool) -> str:
        inner = self.tokens([c for c in n.children if not (not c.named and c.kind in "()[]{}")])
        kind = self.text(n)[0]
        if kind == "[":
            if indexed:
                return "[" + self.expression(inner) + "]"
            words = [self.word(c) for c in inner]
            if "for" in words and "in" in words:
                return self.comprehension(inner, words)
            return "array(" + self.expression(inner) + ")"
        if kind == "{":
            pairs = [self.split(p, ":") for p in self.split(inner, ",")]
            if before == "map":
                return "(" + ", ".join(self.expression(a) + ", " + self.expression(b) for a, b in pairs) + ")"
            return "named_struct(" + ", ".join(f"'{self.text(a[0]).strip(chr(39))}', {self.expression(b)}" for a, b in pairs) + ")"
        first = self.word(inner[0]) if inner else ""
        if first in ("select", "with", "from", "values"):
            return "(" + self.query(inner) + ")"
        if before in ("cast", "try_cast"):
            at = max((k for k, c in enumerate(inner) if self.word(c) == "as"), default=None)
            if at is not None:
                name = self.source[inner[at + 1].start : inner[-1].end].decode("utf-8")
                try:
                    name = spark_type(name)
                except UnknownType:
                    pass
                return "(" + self.expression(inner[:at]) + " AS " + name + ")"
        return "(" + self.expression(inner) + ")"

    def comprehension(self, inner: list[Node], words: list[str]) -> str:
        f, i = words.index("for"), words.index("in")
        c = words.index("if") if "if" in words else len(inner)
        x = self.text(inner[f + 1])
        source = self.expression(inner[i + 1 : c])
        if c < len(inner):
            source = f"filter({source}, {x} -> {self.expression(inner[c + 1 :])})"
        return f"transform({source}, {x} -> {self.expression(inner[:f])})"

    def split(self, nodes: list[Node], mark: str) -> list[list[Node]]:
        out: list[list[Node]] = [[]]
        for n in nodes:
            if not n.named and n.kind == mark:
                out.append([])
            else:
                out[-1].append(n)
        return out

    # -- queries

    def query(self, nodes: list[Node]) -> str:
        nodes = self.tokens(nodes)
        if self.word(nodes[0]) == "with":
            k = next((i for i, n in enumerate(nodes) if i and self.word(n) in ("select", "from", "values", "table")), len(nodes))
            return self.expression([n for n in nodes[:k] if self.word(n) not in ("materialized",) and not (self.word(n) == "not")]) + " " + self.query(nodes[k:])
        parts: list[str] = []
        start = 0
        for k, n in enumerate(nodes):
            if self.word(n) in SETS and not (k and self.word(nodes[k - 1]) == "*") and not (nodes[k - 1].kind == "*"):
                parts.append(self.select(nodes[start:k]))
                parts.append(self.word(n).upper())
                start = k + 1
                if start < len(nodes) and self.word(nodes[start]) in ("all", "distinct"):
                    parts.append(self.word(nodes[start]).upper())
                    start += 1
        parts.append(self.select(nodes[start:]))
        return " ".join(parts)

    def select(self, nodes: list[Node]) -> str:
        if not nodes or self.word(nodes[0]) not in ("select", "from"):
            return self.expression(nodes)
        clauses: dict[str, list[Node]] = {}
        current = None
        for n in nodes:
            w = self.word(n)
            if w in CLAUSES and not (w == "select" and current == "select"):
                if not (current == "fetch" and w == "offset"):
                    current = w
                    clauses[current] = []
                    continue
            if current is None:
                raise NotRewritten("a query that starts with neither SELECT nor FROM")
            clauses[current].append(n)
        columns = clauses.get("select", [])
        distinct = ""
        limit = self.limits(clauses)
        rank: list[str] = []
        order = self.expression(clauses["order"][1:]) if "order" in clauses else ""
        if columns and self.word(columns[0]) == "distinct":
            if len(columns) > 2 and self.word(columns[1]) == "on":
                rank = [f"row_number() OVER (PARTITION BY {self.expression(columns[2].children[1:-1])} ORDER BY {order or '1'}) = 1"]
                columns = columns[3:]
            else:
                distinct, columns = "DISTINCT ", columns[1:]
        if columns and self.word(columns[0]) == "top":
            limit["n"] = self.expression([columns[1]])
            columns = columns[2:]
            if columns and self.word(columns[0]) == "percent":
                raise NotRewritten("percent: use operators.windows.limit_percent")
        items = self.expression(columns) if columns else "*"
        source = self.tables(clauses["from"]) if "from" in clauses else ""
        text = f"SELECT {distinct}{items}" + (f" FROM {source}" if source else "")
        for name, words in (("where", "WHERE"), ("group", "GROUP BY"), ("having", "HAVING"), ("window", "WINDOW")):
            if name in clauses:
                text += f" {words} " + self.expression(clauses[name][1:] if name == "group" else clauses[name])
        if "qualify" in clauses:
            rank.append(self.expression(clauses["qualify"]))
        if limit.get("ties"):
            rank.append(f"rank() OVER (ORDER BY {order}) <= {limit.pop('n')}")
        if limit.get("by"):
            rank.append(f"row_number() OVER (PARTITION BY {limit['by']} ORDER BY {order or '1'}) <= {limit.pop('n')}")
        if rank:
            body = text.replace(f"SELECT {distinct}{items}", f"SELECT {distinct}{items}, ({' AND '.join(f'({r})' for r in rank)}) AS _kept", 1)
            text = f"SELECT * EXCEPT (_kept) FROM ({body}) WHERE _kept"
        if order:
            text += f" ORDER BY {order}"
        if "n" in limit:
            text += f" LIMIT {limit['n']}"
        if "offset" in limit:
            text += f" OFFSET {limit['offset']}"
        return text

    def limits(self, clauses: dict[str, list[Node]]) -> dict[str, str]:
        out: dict[str, str] = {}
        if (own := clauses.get("limit")) is not None:
            words = [self.word(n) for n in own]
            if "by" in words:
                at = words.index("by")
                out["by"], own = self.expression(own[at + 1 :]), own[:at]
            if any(n.kind == "%" or self.word(n) == "percent" for n in own):
                raise NotRewritten("percent: use operators.windows.limit_percent")
            pieces = self.split(own, ",")
            if len(pieces) == 2:
                out["offset"], out["n"] = self.expression(pieces[0]), self.expression(pieces[1])
            else:
                out["n"] = self.expression(own)
        if (own := clauses.get("offset")) is not None:
            out["offset"] = self.expression([n for n in own if self.word(n) not in ("row", "rows")])
        if (own := clauses.get("fetch")) is not None:
            words = [self.word(n) for n in own]
            if "percent" in words:
                raise NotRewritten("percent: use operators.windows.limit_percent")
            out["n"] = next((self.text(n) for n in own if n.kind in ("number", "parameter")), "1")
            if "ties" in words:
                out["ties"] = "1"
        return out

    def tables(self, nodes: list[Node]) -> str:
        out, k = [], 0
        pieces: list[Node] = []
        while k < len(nodes):
            n = nodes[k]
            if n.kind == "string" and (k == 0 or self.word(nodes[k - 1]) in ("join", "from") or nodes[k - 1].kind == ","):
                out.append(self.expression(pieces))
                path = self.text(n)[1:-1]
                kind = FORMATS.get(re.sub(r"\.(gz|zst|bz2)$", "", path).rsplit(".", 1)[-1], "parquet")
                out.append(f"{kind}.`{path}`")
                pieces = []
            else:
                pieces.append(n)
            k += 1
        out.append(self.expression(pieces))
        return " ".join(p for p in out if p)


ESCAPE = re.compile(r"\{\s*(fn|ts|d|t|oj|escape|interval)\s+([^{}]*?)\s*\}", re.I)
STRINGS = re.compile(r"'(?:[^']|'')*'")
MARK = re.compile(r"\(\s*\+\s*\)")


def odbc(text: str) -> str:
    """The text with its {fn ..}, {d ..}, {t ..}, {ts ..}, {oj ..}, {escape ..} and {interval ..} as plain SQL."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\x00{len(held) - 1}\x00"

    text = STRINGS.sub(hold, text)
    words = {"d": "DATE ", "t": "TIME ", "ts": "TIMESTAMP_NTZ ", "fn": "", "oj": "", "escape": "ESCAPE ", "interval": "INTERVAL "}
    while ESCAPE.search(text):
        text = ESCAPE.sub(lambda m: words[m[1].lower()] + m[2], text)
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)


def outer_marks(text: str, options: Options | str = "oracle") -> str:
    """A comma list of relations with conditions marked (+) as left joins; other texts are as they were."""
    if not MARK.search(text):
        return text
    source = text.encode("utf-8")
    root = parse_sql_tree(source, options)
    statement = next(n for n in root.children if n.kind == "statement")
    by = {n.kind: n for n in statement.children}
    start, where = by.get("from_clause"), by.get("where_clause")
    if start is None or where is None or any(n.kind == "join" for n in start.children):
        raise NotRewritten("(+): a comma list and conditions")
    own = lambda n: source[n.start : n.end].decode("utf-8")

    def conditions(n: Node) -> list[str]:
        if n.kind == "binary_expression" and [own(c).lower() for c in n.children if c.field == "operator"] == ["and"]:
            return [x for c in n.children if c.field in ("left", "right") for x in conditions(c)]
        return [own(n)]

    names = {}
    for r in start.children:
        if r.kind == "relation":
            alias = next((c for a in r.children if a.kind == "alias" for c in a.children if c.field == "name"), None)
            names[(own(alias) if alias else own(r).split(".")[-1]).lower()] = own(r)
    plain, marked = [], {}
    for c in conditions(where.children[-1]):
        tables = {m.lower() for m in re.findall(r"(\w+)\.\w+\s*\(\s*\+\s*\)", c)}
        if not tables:
            plain.append(c)
        elif len(tables) > 1 or not tables <= names.keys():
            raise NotRewritten("(+): one relation in a condition")
        else:
            marked.setdefault(tables.pop(), []).append(MARK.sub("", c))
    relations = ", ".join(r for n, r in names.items() if n not in marked) or "(SELECT 1)"
    joins = "".join(f" LEFT JOIN {names[n]} ON {' AND '.join(cs)}" for n, cs in marked.items())
    rest = f" WHERE {' AND '.join(plain)}" if plain else ""
    return text[: len(source[: start.start].decode("utf-8"))] + f"FROM {relations}{joins}{rest}" + source[where.end :].decode("utf-8")


def to_spark(text: str, dialect: str | Options = "duckdb") -> str:
    """The first statement of a dialect's text as Spark SQL."""
    text = outer_marks(odbc(text), dialect)
    source = text.encode("utf-8")
    options = DIALECTS[dialect] if isinstance(dialect, str) else dialect
    for n in parse_sql(source, options).children:
        if n.kind == "statement":
            return _Rewriter(source).query(n.children)
    raise NotRewritten("no statement")


def run(spark: SparkSession, text: str, dialect: str | Options = "duckdb", **tables: DataFrame) -> DataFrame:
    """Runs a dialect's query over the given tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(to_spark(text, dialect))


PROCEDURE = re.compile(r"\s*CREATE\s+(?:OR\s+REPLACE\s+)?PROCEDURE\s+(\w+)\s*\((.*?)\)\s*(?:LANGUAGE\s+SQL\s+)?(?:AS\s+|IS\s+)?BEGIN\b(.*)\bEND\s*;?\s*", re.I | re.S)
PARAMETER = re.compile(r"\s*(?:IN\s+)?(\w+)\s+(.+?)(?:\s+DEFAULT\s+(.+))?\s*", re.I | re.S)
CALL = re.compile(r"\s*(?:CALL|EXEC|EXECUTE)\s+(\w+)\s*\((.*)\)\s*;?\s*", re.I | re.S)


class Procedures:
    """CREATE PROCEDURE and CALL: a body of SQL statements, control flow among them, whose parameters are variables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.known: dict[str, tuple[list[tuple[str, str, str | None]], str]] = {}

    @staticmethod
    def _parts(text: str) -> list[str]:
        """What is between commas outside brackets and strings."""
        found = re.findall(r"(?:'(?:[^']|'')*'|\((?:[^()]|\([^()]*\))*\)|[^,'()])+", text)
        return [p.strip() for p in found if p.strip()]

    def create(self, text: str) -> None:
        m = PROCEDURE.fullmatch(text)
        if m is None:
            raise NotRewritten("CREATE PROCEDURE name(parameters) BEGIN .. END")
        own = []
        for p in self._parts(m[2]):
            found = PARAMETER.fullmatch(p)
            if found is None or p.upper().startswith(("OUT ", "INOUT ")):
                raise NotRewritten(f"parameter {p}")
            own.append((found[1], spark_type(found[2]), found[3]))
        self.known[m[1].lower()] = (own, m[3].strip())

    def call(self, text: str) -> DataFrame:
        """The rows of the last statement. Arguments stand in order or as name => value; parameters without one take their default."""
        m = CALL.fullmatch(text)
        if m is None or m[1].lower() not in self.known:
            raise NotRewritten(f"no procedure: {text}")
        parameters, body = self.known[m[1].lower()]
        values: dict[str, str] = {}
        for k, a in enumerate(self._parts(m[2])):
            named = re.fullmatch(r"(\w+)\s*(?:=>|:=)\s*(.+)", a, re.S)
            if named:
                values[named[1].lower()] = named[2]
            elif k < len(parameters):
                values[parameters[k][0].lower()] = a
            else:
                raise NotRewritten(f"too many arguments: {text}")
        unknown = values.keys() - {p.lower() for p, *_ in parameters}
        missing = [p for p, _, default in parameters if default is None and p.lower() not in values]
        if unknown or missing:
            raise NotRewritten(f"arguments: {sorted(unknown) + missing}")
        declared = " ".join(f"DECLARE {p} {kind} DEFAULT {values.get(p.lower(), default)};" for p, kind, default in parameters)
        return self.spark.sql(f"BEGIN {declared} {body if body.endswith(';') else body + ';'} END")
