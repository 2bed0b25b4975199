"""Other query languages as DataFrames: SPARQL over triples, Cypher over nodes and edges, CQL over tables, GraphQL over tables.

Each text is read by a small recursive reader and becomes joins, filters and aggregates, which the optimizer then plans.
What a reader does not know is an error that names it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.operators import recursion


class NotRead(ValueError):
    """A form that is not read."""


class _Tokens:
    def __init__(self, text: str, pattern: str):
        self.all = [m for m in re.findall(pattern, text) if not m.isspace() and not m.startswith("#")]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.all[k] if k < len(self.all) else ""

    def next(self) -> str:
        self.at += 1
        return self.all[self.at - 1] if self.at <= len(self.all) else ""

    def word(self, *words: str) -> bool:
        """Takes the words, in any case, if they come next."""
        if [self.peek(k).upper() for k in range(len(words))] == [w.upper() for w in words]:
            self.at += len(words)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.word(token):
            raise NotRead(f"{token} is expected, not {self.peek()!r}")


# ---- SPARQL

SPARQL = r"\s+|#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|<[^>\s]*>|\?\w+|\$\w+|&&|\|\||[<>!]=|\d+(?:\.\d+)?|[A-Za-z_][\w-]*:[\w-]*|:[\w-]+|[A-Za-z_]\w*|[{}().,;=<>!*/|+?^\-\[\]]"


def _unquoted(token: str) -> str:
    return re.sub(r"\\(.)", r"\1", token[1:-1])


class Sparql:
    """SELECT, ASK and CONSTRUCT over a table of triples (s, p, o) of texts.

    Read are basic patterns with `;` and `,`, paths of |, /, ^, + and *, OPTIONAL, UNION, MINUS, FILTER, BIND, VALUES,
    sub-selects, GROUP BY with count, sum, min, max, avg and sample, HAVING, ORDER BY, LIMIT, OFFSET and DISTINCT.
    Names in <..> stand for what is between; prefixed names for themselves.
    """

    def __init__(self, triples: DataFrame):
        self.triples = triples.select("s", "p", "o")
        self.spark = triples.sparkSession

    def run(self, text: str) -> DataFrame:
        self.t = _Tokens(text, SPARQL)
        while self.t.word("PREFIX"):
            self.t.next()
            self.t.next()
        if self.t.word("ASK"):
            self.t.word("WHERE")
            return self.group().limit(1).agg((F.count("*") > 0).alias("yes"))
        if self.t.word("CONSTRUCT"):
            self.t.need("{")
            template = []
            while not self.t.word("}"):
                template.append((self.term(), self.term(), self.term()))
                self.t.word(".")
            self.t.word("WHERE")
            d = self.group()
            out = None
            for each in template:
                part = d.select(*[(F.col(x[1]) if x[0] == "var" else F.lit(x[1])).cast("string").alias(n) for x, n in zip(each, "spo")]).where("s is not null and p is not null and o is not null")
                out = part if out is None else out.unionAll(part)
            return out.distinct()
        return self.select()

    # -- queries

    def select(self) -> DataFrame:
        t = self.t
        t.need("SELECT")
        distinct = t.word("DISTINCT") or t.word("REDUCED")
        chosen: list[tuple[str, object]] | None = []
        if t.word("*"):
            chosen = None
        while chosen is not None and (t.peek()[:1] in "?$" and t.peek() or t.peek() == "("):
            if t.word("("):
                expression = self.expression()
                t.need("AS")
                chosen.append((t.next()[1:], expression))
                t.need(")")
            else:
                name = t.next()[1:]
                chosen.append((name, ("var", name)))
        t.word("WHERE")
        d = self.group()
        keys: list[tuple[str, object]] = []
        grouped = t.word("GROUP", "BY")
        while grouped and (t.peek()[:1] == "?" or t.peek() == "("):
            if t.word("("):
                e = self.expression()
                t.need("AS")
                keys.append((t.next()[1:], e))
                t.need(")")
            else:
                keys.append((t.peek()[1:], ("var", t.next()[1:])))
        having = self.expression() if t.word("HAVING") else None
        order = []
        if t.word("ORDER", "BY"):
            while t.peek() and t.peek().upper() not in ("LIMIT", "OFFSET", "}", "VALUES"):
                down = t.word("DESC")
                t.word("ASC")
                order.append((self.primary(), down))
        limit = offset = None
        while t.peek().upper() in ("LIMIT", "OFFSET"):
            if t.word("LIMIT"):
                limit = int(t.next())
            elif t.word("OFFSET"):
                offset = int(t.next())
        if t.word("VALUES"):
            d = self.joined(d, self.values())
        if chosen is None:
            chosen = [(c, ("var", c)) for c in d.columns]
        if grouped or any(self.aggregates(e) for _, e in chosen) or having:
            for name, e in keys:
                d = d.withColumn(name, self.column(e))
            extra = [("_having", having)] if having else []
            d = d.groupBy(*[n for n, _ in keys]).agg(*([self.column(e).alias(n) for n, e in [*chosen, *extra] if n not in {k for k, _ in keys}] or [F.count("*").alias("_n")]))
            if having:
                d = d.where("_having")
        else:
            for name, e in chosen:
                if e != ("var", name):
                    d = d.withColumn(name, self.column(e))
        if order and not distinct:
            d = d.orderBy(*[(self.column(e).desc() if down else self.column(e).asc()) for e, down in order])
        d = d.select(*[n for n, _ in chosen])
        if distinct:
            d = d.distinct()
            if order:
                d = d.orderBy(*[(self.column(e).desc() if down else self.column(e).asc()) for e, down in order])
        if offset:
            d = d.offset(offset)
        return d if limit is None else d.limit(limit)

    def group(self) -> DataFrame:
        """{ .. }: its patterns joined in order."""
        t = self.t
        t.need("{")
        if t.peek().upper() == "SELECT":
            d = self.select()
            t.need("}")
            return d
        d = None
        filters = []
        while not t.word("}"):
            if t.word("OPTIONAL"):
                d = self.joined(d, self.group(), "left")
            elif t.word("MINUS"):
                other = self.group()
                d = self.joined(d, other, "left_anti") if d is not None and set(d.columns) & set(other.columns) else d
            elif t.word("FILTER"):
                negative = t.word("NOT")
                if t.word("EXISTS"):
                    other = self.group()
                    d = self.joined(d, other, "left_anti" if negative else "left_semi")
                else:
                    filters.append(self.primary() if t.peek() != "(" else self.expression())
            elif t.word("BIND"):
                t.need("(")
                e = self.expression()
                t.need("AS")
                d = d.withColumn(t.next()[1:], self.column(e))
                t.need(")")
            elif t.word("VALUES"):
                d = self.joined(d, self.values())
            elif t.peek() == "{":
                part = self.group()
                while t.word("UNION"):
                    part = part.unionByName(self.group(), allowMissingColumns=True)
                d = self.joined(d, part)
            elif t.word("."):
                pass
            elif not t.peek():
                raise NotRead("an open group")
            else:
                subject = self.term()
                while True:
                    path = self.path()
                    while True:
                        d = self.joined(d, self.pattern(subject, path, self.term()))
                        if not t.word(","):
                            break
                    if not t.word(";") or t.peek() in (".", "}"):
                        break
        for e in filters:
            d = d.where(self.column(e))
        return d

    def values(self) -> DataFrame:
        t = self.t
        many = t.word("(")
        names = []
        while t.peek()[:1] == "?":
            names.append(t.next()[1:])
        if many:
            t.need(")")
        t.need("{")
        rows = []
        while not t.word("}"):
            if many:
                t.need("(")
            rows.append(tuple(None if t.word("UNDEF") else self.term()[1] for _ in names))
            if many:
                t.need(")")
        return self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))

    def joined(self, a: DataFrame | None, b: DataFrame, how: str = "inner") -> DataFrame:
        if a is None:
            return b
        shared = [c for c in a.columns if c in b.columns]
        if not shared:
            if how in ("left_semi", "left_anti"):
                some = not b.isEmpty()
                return a if some == (how == "left_semi") else a.limit(0)
            raise NotRead("patterns that share no variable")
        return a.join(b, shared, how)

    # -- patterns

    def term(self) -> tuple[str, str]:
        token = self.t.next()
        if token[:1] in "?$" and len(token) > 1:
            return "var", token[1:]
        if token[:1] in "\"'":
            return "text", _unquoted(token)
        if token[:1] == "<":
            return "text", token[1:-1]
        if not token or token in "{}().;,":
            raise NotRead(f"a term is expected, not {token!r}")
        return "text", token[1:] if token[0] == ":" else token

    def path(self):
        t = self.t
        out = [self.sequence()]
        while t.word("|"):
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("or", out)

    def sequence(self):
        out = [self.step()]
        while self.t.word("/"):
            out.append(self.step())
        return out[0] if len(out) == 1 else ("then", out)

    def step(self):
        t = self.t
        if t.word("^"):
            return "back", self.step()
        if t.word("("):
            out = self.path()
            t.need(")")
        else:
            out = ("one", self.term())
        if t.peek() in ("+", "*") and t.peek():
            out = ("many", out, t.next() == "*")
        return out

    def edges(self, path) -> DataFrame:
        """(a, b, and the predicate's variable if it is one) of a path."""
        kind = path[0]
        if kind == "one":
            what, name = path[1]
            d = self.triples.where(F.col("p") == name) if what == "text" else self.triples
            return d.select(F.col("s").alias("_a"), F.col("o").alias("_b"), *([F.col("p").alias(name)] if what == "var" else []))
        if kind == "back":
            d = self.edges(path[1])
            return d.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"), *[c for c in d.columns if c not in ("_a", "_b")])
        if kind == "or":
            out = None
            for p in path[1]:
                d = self.edges(p).select("_a", "_b")
                out = d if out is None else out.unionAll(d)
            return out
        if kind == "then":
            out = self.edges(path[1][0]).select("_a", F.col("_b").alias("_m"))
            for k, p in enumerate(path[1][1:]):
                out = out.join(self.edges(p).select(F.col("_a").alias("_m"), F.col("_b").alias("_n")), "_m").select("_a", F.col("_n").alias("_m"))
            return out.select("_a", F.col("_m").alias("_b"))
        out = recursion.closure(self.edges(path[1]).select(F.col("_a").alias("a"), F.col("_b").alias("b")), "a", "b").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        if path[2]:
            every = self.triples.select("s").unionAll(self.triples.select("o")).distinct()
            out = out.unionAll(every.select(F.col("s").alias("_a"), F.col("s").alias("_b"))).distinct()
        return out

    def pattern(self, subject, path, object_) -> DataFrame:
        d = self.edges(path)
        if subject == object_ and subject[0] == "var":
            d = d.where("_a = _b").drop("_b")
        elif object_[0] == "var":
            if object_[1] in d.columns:
                d = d.where(F.col("_b") == F.col(object_[1])).drop("_b")
            else:
                d = d.withColumnRenamed("_b", object_[1])
        else:
            d = d.where(F.col("_b") == object_[1]).drop("_b")
        return d.withColumnRenamed("_a", subject[1]) if subject[0] == "var" else d.where(F.col("_a") == subject[1]).drop("_a")

    # -- expressions: ("var", name), ("text", value), ("number", value), (operator or function, arguments ..)

    def expression(self, least: int = 0):
        levels = {"||": 1, "&&": 2, "=": 3, "!=": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5}
        left = self.primary()
        while self.t.peek() in levels and levels[self.t.peek()] > least or self.t.peek().upper() in ("IN", "NOT") and least < 3:
            if self.t.peek().upper() in ("IN", "NOT"):
                negative = self.t.word("NOT")
                self.t.need("IN")
                left = ("in", left, self.arguments())
                left = ("!", left) if negative else left
                continue
            op = self.t.next()
            left = (op, left, self.expression(levels[op]))
        return left

    def arguments(self) -> list:
        self.t.need("(")
        out = []
        while not self.t.word(")"):
            out.append(("star",) if self.t.word("*") else self.expression())
            self.t.word(",")
        return out

    def primary(self):
        t = self.t
        if t.word("("):
            e = self.expression()
            t.need(")")
            return e
        if t.word("!"):
            return "!", self.primary()
        token = t.peek()
        if re.fullmatch(r"\d+(?:\.\d+)?", token):
            t.next()
            return "number", float(token) if "." in token else int(token)
        if re.fullmatch(r"[A-Za-z]\w*", token) and t.peek(1) == "(":
            name = t.next().lower()
            if t.peek(1).upper() == "DISTINCT":
                t.need("(")
                t.next()
                e = self.expression()
                t.need(")")
                return f"{name} distinct", e
            return (name, *self.arguments())
        return self.term()

    AGGREGATES = frozenset(["count", "sum", "min", "max", "avg", "sample", "count distinct", "sum distinct"])

    def aggregates(self, e) -> bool:
        return isinstance(e, tuple) and bool(e) and (e[0] in self.AGGREGATES or any(self.aggregates(x) for x in e[1:] if isinstance(x, tuple)))

    def column(self, e) -> Column:
        kind, *own = e
        if kind == "var":
            return F.col(own[0])
        if kind in ("text", "number"):
            return F.lit(own[0])
        if kind == "in":
            return self.column(own[0]).isin(*[self.column(x) for x in own[1]])
        if kind == "count" and own == [("star",)]:
            return F.count("*")
        if kind == "bound":
            return self.column(own[0]).isNotNull()
        c = [self.column(x) for x in own]
        number = lambda x: x.cast("double")
        if kind in ("<", ">", "<=", ">=") and any(x[0] == "number" or x[0] in "+-*/" for x in own) or kind in ("=", "!=") and any(x[0] == "number" for x in own):
            c = [number(x) for x in c]
        made = {
            "||": lambda: c[0] | c[1], "&&": lambda: c[0] & c[1], "!": lambda: ~c[0], "=": lambda: c[0] == c[1], "!=": lambda: c[0] != c[1], "<": lambda: c[0] < c[1], ">": lambda: c[0] > c[1], "<=": lambda: c[0] <= c[1], ">=": lambda: c[0] >= c[1],
            "+": lambda: number(c[0]) + number(c[1]), "-": lambda: number(c[0]) - number(c[1]), "*": lambda: number(c[0]) * number(c[1]), "/": lambda: number(c[0]) / number(c[1]),
            "count": lambda: F.count(c[0]), "count distinct": lambda: F.count_distinct(c[0]), "sum": lambda: F.sum(number(c[0])), "sum distinct": lambda: F.sum_distinct(number(c[0])), "min": lambda: F.min(c[0]), "max": lambda: F.max(c[0]), "avg": lambda: F.avg(number(c[0])), "sample": lambda: F.min(c[0]),
            "regex": lambda: c[0].rlike(("(?i)" if len(own) > 2 and "i" in own[2][1] else "") + own[1][1]), "str": lambda: c[0].cast("string"), "strlen": lambda: F.length(c[0]), "ucase": lambda: F.upper(c[0]), "lcase": lambda: F.lower(c[0]), "contains": lambda: F.contains(*c), "strstarts": lambda: F.startswith(*c), "strends": lambda: F.endswith(*c),
            "concat": lambda: F.concat(*c), "coalesce": lambda: F.coalesce(*c), "if": lambda: F.when(c[0], c[1]).otherwise(c[2]), "abs": lambda: F.abs(number(c[0])), "replace": lambda: F.regexp_replace(c[0], own[1][1], own[2][1]), "substr": lambda: F.substring(c[0], own[1][1], own[2][1] if len(own) > 2 else 1 << 30),
        }.get(kind)
        if made is None:
            raise NotRead(f"{kind}()")
        return made()


def sparql(triples: DataFrame, text: str) -> DataFrame:
    return Sparql(triples).run(text)


def triples_of(df: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """(s, p, o): a triple for each column of each row but its key; nulls have none."""
    cols = [c for c in df.columns if c != key]
    each = F.array(*[F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o")) for c in cols])
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("s"), F.inline(each)).where("o is not null")


# ---- Cypher

CYPHER = r"\s+|//[^\n]*|\"[^\"]*\"|'[^']*'|<-|->|<>|<=|>=|=~|\.\.|\d+(?:\.\d+)?|[A-Za-z_]\w*|[()\[\]{}:,.*=<>|+\-/]"


@dataclass
class Graph:
    """nodes: {label: (table, key)}; edges: {type: (table, from column, to column)}."""

    nodes: dict[str, tuple[DataFrame, str]]
    edges: dict[str, tuple[DataFrame, str, str]] = field(default_factory=dict)


def cypher(graph: Graph, text: str) -> DataFrame:
    """MATCH paths of labelled nodes and typed edges, [:T*a..b] among them, WHERE, RETURN with aggregates, ORDER BY, SKIP and LIMIT.

    Expressions are Spark SQL's over variable.property; a variable alone is its key.
    """
    t = _Tokens(text, CYPHER)
    t.need("MATCH")
    d: DataFrame | None = None
    known: dict[str, str] = {}
    fresh = iter(range(10_000))

    def node():
        t.need("(")
        name = t.next() if re.fullmatch(r"[A-Za-z_]\w*", t.peek()) else f"_n{next(fresh)}"
        label = t.next() if t.word(":") else None
        given = {}
        if t.word("{"):
            while not t.word("}"):
                k = t.next()
                t.need(":")
                v = t.next()
                given[k] = v[1:-1] if v[:1] in "\"'" else float(v) if "." in v else int(v)
                t.word(",")
        t.need(")")
        return name, label, given

    def rows(name, label, given) -> DataFrame:
        if label is None:
            raise NotRead(f"a node without a label: {name}")
        table, key = graph.nodes[label]
        for k, v in given.items():
            table = table.where(F.col(k) == v)
        known[name] = key
        return table.select(*[F.col(c).alias(f"{name}.{c}") for c in table.columns])

    def column(name: str, c: str) -> Column:
        return F.col(f"`{name}.{c}`")

    while True:
        name, label, given = node()
        if name not in known:
            r = rows(name, label, given)
            if d is not None:
                raise NotRead("paths that share no variable")
            d = r
        while t.peek() in ("-", "<-"):
            back = t.next() == "<-"
            t.need("[")
            if re.fullmatch(r"[A-Za-z_]\w*", t.peek()):
                t.next()
            t.need(":")
            kinds = [t.next()]
            while t.word("|"):
                t.word(":")
                kinds.append(t.next())
            least = most = 1
            if t.word("*"):
                least, most = 1, 10
                if t.peek().isdigit():
                    least = most = int(t.next())
                if t.word(".."):
                    most = int(t.next()) if t.peek().isdigit() else 10
            t.need("]")
            if not back and t.word("->"):
                pass
            elif back:
                t.need("-")
            else:
                raise NotRead("edges without a direction")
            edge = None
            for kind in kinds:
                table, a, b = graph.edges[kind]
                e = table.select(F.col(a).alias("_x"), F.col(b).alias("_y")).where("_x is not null and _y is not null")
                edge = e if edge is None else edge.unionAll(e)
            if back:
                edge = edge.select(F.col("_y").alias("_x"), F.col("_x").alias("_y"))
            one = F.struct("_x", "_y")
            hop = edge.select("_x", "_y", F.array(one).alias("_p"))
            found = edge if least == 1 else None
            for length in range(2, most + 1):  # a path takes no edge twice
                more = edge.select(F.col("_x").alias("_y"), F.col("_y").alias("_z"), one.alias("_e"))
                hop = hop.join(more, "_y").where(~F.array_contains("_p", F.col("_e"))).select("_x", F.col("_z").alias("_y"), F.concat("_p", F.array("_e")).alias("_p"))
                if length >= least:
                    found = hop.select("_x", "_y") if found is None else found.unionAll(hop.select("_x", "_y"))
            other, label, given = node()
            d = d.join(found, column(name, known[name]) == F.col("_x")).drop("_x")
            if other in known:
                d = d.where(column(other, known[other]) == F.col("_y")).drop("_y")
            else:
                r = rows(other, label, given)
                d = d.join(r, F.col("_y") == column(other, known[other])).drop("_y")
            name = other
        if not t.word(","):
            break

    def expression(stops: tuple[str, ...]) -> str:
        out, level = [], 0
        while t.peek() and not (level == 0 and t.peek().upper() in stops):
            x = t.next()
            level += (x in "([") - (x in ")]")
            if re.fullmatch(r"[A-Za-z_]\w*", x) and x in known:
                if t.word("."):
                    out.append(f"`{x}.{t.next()}`")
                else:
                    out.append(f"`{x}.{known[x]}`")
            elif x[:1] == '"':
                out.append("'" + x[1:-1].replace("'", "\\'") + "'")
            elif x == "=~":
                out.append("RLIKE")
            elif x.upper() == "COLLECT":
                out.append("collect_list")
            else:
                out.append(x)
        text = " ".join(out)
        text = re.sub(r"(\S+) STARTS WITH (\S+)", r"startswith(\1, \2)", text, flags=re.I)
        return re.sub(r"(\S+) CONTAINS (\S+)", r"contains(\1, \2)", text, flags=re.I)

    if t.word("WHERE"):
        d = d.where(expression(("RETURN",)))
    t.need("RETURN")
    distinct = t.word("DISTINCT")
    ends = (",", "ORDER", "SKIP", "LIMIT")
    out = []
    while True:
        e = expression((*ends, "AS"))
        out.append((t.next() if t.word("AS") else e.replace("`", "").split(".")[-1], e))
        if not t.word(","):
            break
    total = re.compile(r"\b(count|sum|min|max|avg|collect_list)\s*\(", re.I)
    keys = [F.expr(e).alias(n) for n, e in out if not total.match(e)]
    sums = [F.expr(e).alias(n) for n, e in out if total.match(e)]
    d = d.groupBy(*keys).agg(*sums).select(*[n for n, _ in out]) if sums else d.select(*keys)
    if distinct:
        d = d.distinct()
    if t.word("ORDER"):
        t.need("BY")
        order = []
        while True:
            name = t.next()
            order.append(F.desc(name) if t.word("DESC") else F.asc(name))
            t.word("ASC")
            if not t.word(","):
                break
        d = d.orderBy(*order)
    if t.word("SKIP"):
        d = d.offset(int(t.next()))
    if t.word("LIMIT"):
        d = d.limit(int(t.next()))
    if t.peek():
        raise NotRead(t.peek())
    return d


# ---- CQL

CQL = re.compile(
    r"\s*SELECT\s+(?P<json>JSON\s+)?(?P<distinct>DISTINCT\s+)?(?P<what>.+?)\s+FROM\s+(?P<table>[\w.]+)(?:\s+WHERE\s+(?P<where>.+?))?(?:\s+GROUP\s+BY\s+(?P<group>.+?))?(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+PER\s+PARTITION\s+LIMIT\s+(?P<per>\d+))?(?:\s+LIMIT\s+(?P<limit>\d+))?(?:\s+ALLOW\s+FILTERING)?\s*;?\s*",
    re.I | re.S,
)


def cql(tables: dict[str, DataFrame], text: str, partition_keys: dict[str, list[str]] | None = None, clustering: dict[str, list[str]] | None = None) -> DataFrame:
    """A CQL SELECT: JSON, DISTINCT, WHERE with IN, CONTAINS and token(), GROUP BY, ORDER BY, PER PARTITION LIMIT, LIMIT and ALLOW FILTERING.

    partition_keys and clustering: a table's keys, by which PER PARTITION LIMIT counts and token() hashes.
    """
    m = CQL.fullmatch(text)
    if m is None:
        raise NotRead(text)
    name = m["table"].split(".")[-1]
    d = tables[name]
    spark_text = lambda s: re.sub(r"\btoken\s*\(", "xxhash64(", re.sub(r"(\w+)\s+CONTAINS\s+KEY\s+('[^']*'|\S+)", r"map_contains_key(\1, \2)", re.sub(r"(\w+)\s+CONTAINS\s+(?!KEY\b)('[^']*'|\S+)", r"array_contains(\1, \2)", s, flags=re.I), flags=re.I), flags=re.I)
    if m["where"]:
        d = d.where(spark_text(m["where"]))
    if m["per"]:
        from pyspark.sql import Window

        w = Window.partitionBy(*(partition_keys or {})[name]).orderBy(*((clustering or {}).get(name) or (partition_keys or {})[name]))
        d = d.withColumn("_per", F.row_number().over(w)).where(F.col("_per") <= int(m["per"])).drop("_per")
    order = [F.desc(p.split()[0]) if p.strip().upper().endswith(" DESC") else F.asc(p.split()[0]) for p in (m["order"] or "").split(",") if p.strip()]
    if order and not (m["distinct"] or m["group"]):
        d = d.orderBy(*order)
    items = [x.strip() for x in re.split(r",(?![^(]*\))", m["what"])]
    expressions = [F.expr("*" if x == "*" else spark_text(x)) for x in items]
    if m["group"]:
        keys = [k.strip() for k in m["group"].split(",")]
        d = d.groupBy(*keys).agg(*[e for x, e in zip(items, expressions) if x not in keys]).select(*[x if x in keys else _named(x) for x in items])
    elif any(re.match(r"(?i)(count|sum|min|max|avg)\s*\(", x) for x in items):
        d = d.agg(*expressions)
    else:
        d = d.select(*expressions)
    if m["distinct"]:
        d = d.distinct()
    if order and (m["distinct"] or m["group"]):
        d = d.orderBy(*order)
    if m["limit"]:
        d = d.limit(int(m["limit"]))
    return d.select(F.to_json(F.struct("*")).alias("[json]")) if m["json"] else d


def _named(item: str) -> Column:
    found = re.search(r"\s+AS\s+(\w+)$", item, re.I)
    if not found:
        raise NotRead(f"{item}: give it a name")
    return F.col(found[1])


# ---- GraphQL

GRAPHQL = r"\s+|#[^\n]*|\"[^\"]*\"|\.\.\.|[A-Za-z_]\w*|-?\d+(?:\.\d+)?|[{}()\[\]:,!@$=]"


@dataclass
class Type:
    """A table, and its fields that are other types: {field: (type, own column, its column, whether it is a list)}."""

    table: DataFrame
    links: dict[str, tuple[str, str, str, bool]] = field(default_factory=dict)


def graphql(types: dict[str, Type], text: str, variables: dict | None = None) -> DataFrame:
    """The selection of one type as rows: arguments filter, nested types are structs or lists, aliases, fragments, @include and @skip are read.

    Arguments `first` and `offset` cut the rows of the outermost type, in order of its first column.
    """
    t = _Tokens(text, GRAPHQL)
    variables = variables or {}
    fragments: dict[str, list] = {}

    def value():
        x = t.next()
        if x == "$":
            return variables.get(t.next())
        if x == "[":
            out = []
            while not t.word("]"):
                out.append(value())
                t.word(",")
            return out
        return x[1:-1] if x[0] == '"' else {"true": True, "false": False, "null": None}[x] if x in ("true", "false", "null") else float(x) if "." in x else int(x)

    def arguments() -> dict:
        out = {}
        if t.word("("):
            while not t.word(")"):
                k = t.next()
                t.need(":")
                out[k] = value()
                t.word(",")
        return out

    def wanted() -> bool:
        keep = True
        while t.word("@"):
            kind, own = t.next(), arguments()
            keep = keep and (bool(own["if"]) if kind == "include" else not own["if"])
        return keep

    def selection() -> list:
        t.need("{")
        out = []
        while not t.word("}"):
            if t.word("..."):
                if t.word("on"):
                    t.next()
                    keep = wanted()
                    own = selection()
                else:
                    name = t.next()
                    keep, own = wanted(), [("spread", name)]
                out += own if keep else []
            else:
                name = t.next()
                alias = name
                if t.word(":"):
                    name = t.next()
                given = arguments()
                keep = wanted()
                below = selection() if t.peek() == "{" else None
                if keep:
                    out.append((alias, name, given, below))
            t.word(",")
        return out

    top = None
    while t.peek():
        if t.word("fragment"):
            name = t.next()
            t.need("on")
            t.next()
            fragments[name] = selection()
        else:
            if t.word("query"):
                if t.peek() not in ("{", "("):
                    t.next()
                if t.word("("):  # declarations; values come with the call
                    while not t.word(")"):
                        t.next()
            top = selection()

    def spread(own: list) -> list:
        return [x for s in own for x in (spread(fragments[s[1]]) if s[0] == "spread" else [s])]

    def rows(kind: str, given: dict, below: list, link: str | None = None) -> DataFrame:
        own = types[kind]
        d = own.table
        for k, v in given.items():
            if k not in ("first", "offset"):
                d = d.where(F.col(k).isin(v) if isinstance(v, list) else F.col(k).eqNullSafe(F.lit(v)))
        made = []
        for n, (alias, name, arguments_, nested) in enumerate(spread(below)):
            if nested is None:
                made.append((alias, F.col(name)))
                continue
            to, mine, its, many = own.links[name]
            inner = rows(to, arguments_, nested, its)
            fields = [c for c in inner.columns if c != "_link"]
            each = F.struct(*fields)
            packed = inner.groupBy("_link").agg((F.sort_array(F.collect_list(each)) if many else F.min(each)).alias(f"_v{n}")).withColumnRenamed("_link", f"_k{n}")
            d = d.join(packed, F.col(mine) == F.col(f"_k{n}"), "left")
            empty = F.array().cast(packed.schema[f"_v{n}"].dataType) if many else None
            made.append((alias, F.coalesce(F.col(f"_v{n}"), empty) if many else F.col(f"_v{n}")))
        if "first" in given or "offset" in given:
            d = d.orderBy(own.table.columns[0]).offset(given.get("offset") or 0)
            d = d.limit(given["first"]) if "first" in given else d
        return d.select(*([F.col(link).alias("_link")] if link else []), *[c.alias(a) for a, c in made])

    if not top or len(spread(top)) != 1:
        raise NotRead("one type at the top")
    _, name, given, below = spread(top)[0]
    return rows(name, given, below or [])
