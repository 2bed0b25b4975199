"""Operators over syntax trees as DataFrames: parsing, navigation, queries, injection, scopes, highlighting and change."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from arborlake.operators.storage import cut, small
from arborlake.syntax import FIELDS, KINDS, LANGUAGES
from arborlake.syntax.change import changed
from arborlake.syntax.match import Matcher
from arborlake.syntax.nodes import COLUMNS, NODES_SCHEMA, Node, columns as node_columns, line_starts, placed, sexp, walk
from arborlake.syntax.query import Item, Query

FLUSH = 4096


def compiled(query: str, language: str | None = None) -> Query:
    """The query; with a language its names are checked as well."""
    return Query(query, KINDS.get(language), None, FIELDS.get(language))


@lru_cache(maxsize=64)
def _matcher(query: str, language: str) -> Matcher:
    return Matcher(compiled(query, language))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if a scan of few files would leave most of them idle: parsing costs far more than moving texts once."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df  # dealt already
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


def _each_text(df: DataFrame, id_col: str, text_col: str, schema: str, one: Callable[[object, bytes], Iterator[tuple]], more: list[str] = ()) -> DataFrame:
    """Rows of one(id, bytes, *more) for each text, streamed in batches of bounded size. Null texts give none."""

    def columns(i, text, *rest):
        got = list(one(i, text, *rest))
        return len(got), list(zip(*got))

    return _each_columns(df, id_col, text_col, schema, columns, more)


def _each_columns(df: DataFrame, id_col: str, text_col: str, schema: str, one: Callable[[object, bytes], tuple[int, list]], more: list[str] = ()) -> DataFrame:
    """The same for one(id, bytes, *more) that gives the number of rows and their columns."""
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in arrow]
        held = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(out, arrow)], schema=arrow)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for i, text, *rest in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns]):
                    if text is None:
                        continue
                    n, got = one(i, text if isinstance(text, bytes) else text.encode("utf-8"), *rest)
                    if not n:
                        continue
                    for column, own in zip(out, got):
                        column.extend(own)
                    held += n
                    if held >= FLUSH:
                        yield flush()
                        out, held = [[] for _ in arrow], 0
        if held:
            yield flush()

    return spread(df.select(id_col, text_col, *more)).mapInArrow(run, kind)


def _kind(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def _pieces(source: bytes, ranges) -> tuple[bytes, list[tuple[int, int]] | None]:
    """The text of ordered ranges put together, and where each piece stands."""
    if ranges is None:
        return source, None
    out, shift, at = [], [], 0
    for r in ranges:
        a, b = (r["start"], r["end"]) if isinstance(r, dict) else r
        shift.append((at, a))
        out.append(source[a:b])
        at += len(out[-1])
    return b"".join(out), shift or [(0, 0)]


def _node_schema(columns: list[str] | None) -> tuple[str, list[str]]:
    fields = dict(zip(COLUMNS, NODES_SCHEMA.split(", ")))
    names = list(columns) if columns is not None else COLUMNS
    return ", ".join(fields[c] for c in names), names


def parse(df: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text", ranges_col: str | None = None, kinds: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Every text as rows of syntax nodes; ranges_col, an array of (start, end) byte ranges, limits what is parsed. Offsets, rows and columns are the document's.

    kinds and columns: what is wanted of the nodes. The optimizer can't push a filter or projection into a parser, so
    naming them here keeps rows and columns that nobody reads from being built.
    """
    parser = LANGUAGES[language]
    schema, names = _node_schema(columns)
    wanted = None if kinds is None else frozenset(kinds)

    def one(i, source, ranges=None):
        own, shift = _pieces(source, ranges)
        got = node_columns(parser(own), own, 0, language, names, shift, wanted, source)
        n = len(got[0])
        return n, [[i] * n, *got]

    return _each_columns(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, {schema}", one, [ranges_col] if ranges_col else [])


def sexps(df: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    parser = LANGUAGES[language]
    return _each_text(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, sexp string", lambda i, s: [(i, sexp(parser(s)))])


def text_of(nodes: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """nodes with node_text, inner nodes included: the byte slice of the document."""
    d = docs.select(F.col(id_col), F.encode(text_col, "UTF-8").alias("_b"))
    piece = F.substring("_b", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")).cast("string")
    return nodes.join(d, id_col).withColumn("node_text", piece).drop("_b")


# ---- navigation: joins and windows over the rows of a tree


def _key(id_col: str) -> list[str]:
    return [id_col, "layer_id"]


def _sorted_join(df: DataFrame) -> DataFrame:
    """df for a join that sorts both sides. Spark takes parsed rows for as small as the texts' scan, and broadcasts millions of them."""
    return df.hint("merge")


def _other(nodes: DataFrame, id_col: str, cols: list[str], prefix: str) -> DataFrame:
    return nodes.select(*_key(id_col), *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def parents(nodes: DataFrame, id_col: str = "doc_id", cols: list[str] = ("kind", "start_byte", "end_byte")) -> DataFrame:
    p = _other(nodes, id_col, ["node_id", *cols], "parent_").withColumnRenamed("parent_node_id", "parent_id")
    return nodes.join(_sorted_join(p), [*_key(id_col), "parent_id"])


def children(nodes: DataFrame, of: Column | None = None, named: bool = False) -> DataFrame:
    d = nodes.where("named_child_index is not null") if named else nodes
    return d.where(of) if of is not None else d


def child(nodes: DataFrame, index: int, named: bool = False) -> DataFrame:
    """The child of that index of each node that has one."""
    return nodes.where(F.col("named_child_index" if named else "child_index") == index).where("parent_id is not null")


def children_by_field(nodes: DataFrame, field: str) -> DataFrame:
    """Each child of the field, whichever its parent."""
    return nodes.where((F.col("field") == field) & F.col("parent_id").isNotNull())


def child_by_field(nodes: DataFrame, field: str, id_col: str = "doc_id") -> DataFrame:
    """For each parent its first child of the field."""
    own = nodes.where(F.col("field") == field)
    w = Window.partitionBy(*_key(id_col), "parent_id").orderBy("node_id")
    return own.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def siblings(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """nodes with next_sibling, prev_sibling, next_named and prev_named node ids and the numbers of later ones: all, named, of the same field. Siblings of one parent meet in one task, a document at most."""
    w = Window.partitionBy(*_key(id_col), "parent_id").orderBy("child_index")
    named = F.when(F.col("is_named"), F.col("node_id"))
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    return (
        nodes.withColumn("next_sibling", F.lead("node_id").over(w))
        .withColumn("prev_sibling", F.lag("node_id").over(w))
        .withColumn("next_named", F.first(named, ignorenulls=True).over(after))
        .withColumn("prev_named", F.last(named, ignorenulls=True).over(before))
        .withColumn("n_later", F.count("node_id").over(after))
        .withColumn("n_later_named", F.count(named).over(after))
        .withColumn("n_later_of_field", F.when(F.col("field").isNotNull(), F.count("node_id").over(Window.partitionBy(*_key(id_col), "parent_id", "field").orderBy("child_index").rowsBetween(1, Window.unboundedFollowing))).otherwise(0))
    )


def first_child_for_byte(nodes: DataFrame, offsets: DataFrame, id_col: str = "doc_id", named: bool = False) -> DataFrame:
    """offsets: (id, parent_id, offset); the first child of that parent that ends after the offset."""
    d = children(nodes, None, named).join(offsets, [id_col, "parent_id"]).where("end_byte > offset")
    w = Window.partitionBy(id_col, "parent_id", "offset").orderBy("node_id")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _before(row: str, col: str, other_row: str, other_col: str) -> Column:
    """Whether a point is not behind another."""
    return (F.col(row) < F.col(other_row)) | (F.col(row) == F.col(other_row)) & (F.col(col) <= F.col(other_col))


def first_child_for_point(nodes: DataFrame, points: DataFrame, id_col: str = "doc_id", named: bool = False) -> DataFrame:
    """points: (id, parent_id, row, col); the first child of that parent that ends behind the point."""
    d = children(nodes, None, named).join(points, [id_col, "parent_id"]).where(~_before("end_row", "end_col", "row", "col"))
    w = Window.partitionBy(id_col, "parent_id", "row", "col").orderBy("node_id")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def descendant_for_points(nodes: DataFrame, ranges: DataFrame, id_col: str = "doc_id", named: bool = False) -> DataFrame:
    """ranges: (id, from_row, from_col, to_row, to_col); the smallest node that spans each range of points."""
    d = (nodes.where("is_named") if named else nodes).join(ranges, id_col).where(_before("start_row", "start_col", "from_row", "from_col") & _before("to_row", "to_col", "end_row", "end_col"))
    own = ["from_row", "from_col", "to_row", "to_col"]
    best = d.groupBy(id_col, *own).agg(F.max_by(F.struct(*[c for c in nodes.columns if c != id_col]), F.struct("depth", -F.col("node_id"))).alias("n"))
    return best.select(id_col, *own, "n.*")


def with_offset(nodes: DataFrame, n_bytes: int, row: int, col: int) -> DataFrame:
    """nodes as if their texts began at that byte, row and column of a larger one."""
    out = nodes
    for p in ("start", "end"):
        out = out.withColumn(f"{p}_byte", F.col(f"{p}_byte") + n_bytes).withColumn(f"{p}_col", F.col(f"{p}_col") + F.when(F.col(f"{p}_row") == 0, col).otherwise(0)).withColumn(f"{p}_row", F.col(f"{p}_row") + row)
    return out


def descendant_for_range(nodes: DataFrame, ranges: DataFrame, id_col: str = "doc_id", named: bool = False) -> DataFrame:
    """ranges: (id, range_start, range_end); the smallest node that spans each. Rows of one document meet by an equi-join."""
    d = (nodes.where("is_named") if named else nodes).join(ranges, id_col).where("start_byte <= range_start and end_byte >= range_end")
    best = d.groupBy(id_col, "range_start", "range_end").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != id_col]), F.struct("depth", -F.col("node_id"))).alias("n"))
    return best.select(id_col, "range_start", "range_end", "n.*")


def descendants(nodes: DataFrame, roots: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All descendants of the roots (id, layer_id, node_id), by their ancestors: an equi-join, with root_id."""
    each = nodes.withColumn("root_id", F.explode("ancestors"))
    return each.join(roots.select(*_key(id_col), F.col("node_id").alias("root_id")), [*_key(id_col), "root_id"])


def child_with_descendant(nodes: DataFrame, targets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """targets: (id, layer_id, ancestor_id, target_id); the child of the ancestor on the path to the target."""
    t = nodes.select(*_key(id_col), F.col("node_id").alias("target_id"), F.concat("ancestors", F.array("node_id")).alias("_p"))
    at = F.array_position("_p", F.col("ancestor_id"))
    path = targets.join(_sorted_join(t), [*_key(id_col), "target_id"]).where((at > 0) & (at < F.size("_p"))).withColumn("node_id", F.get("_p", at.cast("int"))).drop("_p")
    return nodes.join(_sorted_join(path), [*_key(id_col), "node_id"])


# ---- queries


def query_texts(
    df: DataFrame,
    language: str,
    query: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    strict: bool = False,
    match_limit: int | None = None,
    seconds: float | None = None,
    disabled_patterns: set[int] = frozenset(),
    disabled_captures: set[str] = frozenset(),
    point_range: tuple[tuple[int, int], tuple[int, int]] | None = None,
    containing_points: tuple[tuple[int, int], tuple[int, int]] | None = None,
    **where,
) -> DataFrame:
    """Matches in every text: (id, match_no, pattern_index, captures, exceeded). Parsing and matching are one pass, without a shuffle.

    Names that the language does not have are errors, as are patterns that can match nothing. Without match_limit and
    seconds all matches are found; with them a text's search ends there, and its rows say so in `exceeded`. Ranges are
    of bytes (byte_range, containing) or of points (row, column).
    """
    parser = LANGUAGES[language]
    compiled(query, language)  # errors show before anything runs

    made: list[Matcher] = []

    def one(i, source):
        if not made:
            made.append(Matcher(compiled(query, language), strict, match_limit, disabled_patterns, disabled_captures))
        matcher = made[0]
        own = dict(where)
        if point_range or containing_points:
            lines = line_starts(source)
            ends = [*[x - 1 for x in lines[1:]], len(source)]
            offset = lambda p: min(ends[p[0]], lines[p[0]] + p[1]) if p[0] < len(lines) else len(source)
            for name, points in (("byte_range", point_range), ("containing", containing_points)):
                if points:
                    own[name] = (offset(points[0]), offset(points[1]))
        text = lambda n: source[n.start : n.end].decode("utf-8", "replace")
        found = matcher.matches(parser(source), source, seconds=seconds, **own)
        n = len(found)
        if not n:
            return 0, []
        captured = [[{"name": c, "kind": x.kind, "start_byte": x.start, "end_byte": x.end, "text": text(x)} for c, x in m.captures] for m in found]
        return n, [[i] * n, range(n), [m.pattern for m in found], captured, [matcher.exceeded] * n]

    capture = "struct<name:string,kind:string,start_byte:int,end_byte:int,text:string>"
    return _each_columns(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, match_no int, pattern_index int, captures array<{capture}>, exceeded boolean", one)


def without(matches: DataFrame, removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """matches but those of removed (id, match_no), whose captures are then no longer seen."""
    return matches.join(removed.select(id_col, "match_no"), [id_col, "match_no"], "left_anti")


def query_info(spark, query: str, language: str | None = None) -> DataFrame:
    """(pattern_index, start_byte, end_byte, rooted, capture, quantifier): what a query is made of, a row for each capture of each pattern."""
    q = compiled(query, language)
    out = []
    for k, p in enumerate(q.patterns):
        own = q.capture_quantifiers(k)
        out += [(k, p.start, p.end, p.rooted, c, own[c]) for c in q.capture_names if c in own] or [(k, p.start, p.end, p.rooted, None, None)]
    return spark.createDataFrame(out, "pattern_index int, start_byte int, end_byte int, rooted boolean, capture string, quantifier string")


def captures(matches: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each capture of each match once, with its place in the order of the text."""
    each = matches.select(id_col, "pattern_index", F.inline("captures")).distinct()
    w = Window.partitionBy(id_col).orderBy("start_byte", F.desc("end_byte"), "pattern_index", "name")
    return each.withColumn("seq", F.row_number().over(w))


class NotPlain(ValueError):
    """A pattern that joins can't express."""


def pattern_kinds(query: str, index: int = 0) -> list[str] | None:
    """The kinds of all nodes that join_query() reads for a pattern; None if it may read any."""

    def of(item: Item) -> set[str] | None:
        if item.form == "node" and (item.kind is None or item.missing or item.supertype or item.negated):
            return None
        below = [of(p) for p in item.parts]
        return None if None in below else set().union(*below, {item.kind} if item.form == "node" else set())

    kinds = of(Query(query).patterns[index].item)
    return None if kinds is None else sorted(kinds)


def join_query(nodes: DataFrame, query: str, index: int = 0, id_col: str = "doc_id", texts: bool = False) -> DataFrame:
    """A pattern without quantifiers, alternations and groups as joins of nodes: (id, layer_id, one node id for each capture), with texts also the text of leaves as <capture>_text.

    A child is an equi-join on the parent, a sibling's order a comparison, a negated field an anti join. #eq?, #match?
    and #any-of? with strings test the text of leaves.
    """
    compiled = Query(query)
    pattern = compiled.patterns[index]
    count = [0]

    def test(item: Item) -> Column:
        if item.form != "node" or item.quantifier:
            raise NotPlain(query)
        c = F.lit(True)
        if item.kind == "ERROR":
            c = F.col("is_error")
        elif item.kind is not None:
            c = ((F.col("kind") == item.kind) & (F.col("is_named") == F.lit(item.named))) | (F.array_contains("supertypes", item.kind) & F.lit(bool(item.named)))
        elif not item.missing:
            c = ~F.col("is_error") & (F.col("is_named") | F.lit(item.named is None))
        if item.missing:
            c = c & F.col("is_missing")
        if item.supertype:
            c = c & F.array_contains("supertypes", item.supertype)
        return c & F.col("field").isin(item.fields) if item.fields else c

    key = _key(id_col)

    def build(item: Item) -> tuple[DataFrame, str]:
        me = f"n{count[0]}"
        count[0] += 1
        cols = ["node_id", "parent_id", "child_index", "named_child_index", "n_children", "n_named", "start_byte", "text"]
        d = nodes.where(test(item)).select(*key, *[F.col(c).alias(f"{me}_{c}") for c in cols])
        for f in item.negated:
            has = nodes.where(F.col("field") == f).select(*key, F.col("parent_id").alias(f"{me}_node_id"))
            d = d.join(_sorted_join(has), [*key, f"{me}_node_id"], "left_anti")
        before = None
        for k, part in enumerate(item.parts):
            c, name = build(part)
            d = d.join(_sorted_join(c.withColumnRenamed(f"{name}_parent_id", f"{me}_node_id")), [*key, f"{me}_node_id"])
            if before is not None:
                d = d.where(F.col(f"{name}_child_index") > F.col(f"{before}_child_index"))
            if part.anchored:
                at = "child_index" if part.exact else "named_child_index"
                d = d.where(F.col(f"{name}_{at}") == (F.col(f"{before}_{at}") + 1 if before else F.lit(0)))
            before = name
        if item.last_anchor:
            n, at = ("n_children", "child_index") if item.parts[-1].exact else ("n_named", "named_child_index")
            d = d.where(F.col(f"{before}_{at}") == F.col(f"{me}_{n}") - 1)
        names[me] = item.captures
        return d, me

    names: dict[str, list[str]] = {}
    top = pattern.item
    while top.form == "group" and len(top.parts) == 1 and not top.captures:
        top = top.parts[0]
    d, _ = build(top)
    at = {c: me for me, cs in names.items() for c in cs}
    for p in pattern.predicates:
        if p.name not in ("eq?", "not-eq?", "match?", "not-match?", "any-of?", "not-any-of?"):
            continue
        if any(k == "capture" for k, _ in p.args[1:]):
            raise NotPlain(query)
        t = F.col(f"{at[p.args[0][1]]}_text")
        own = [v for _, v in p.args[1:]]
        c = t.isin(own) if "of" in p.name or "eq" in p.name else t.rlike(own[0])
        d = d.where(~c if p.name.startswith("not-") else c)
    return d.select(*key, *[F.col(f"{me}_node_id").alias(c) for c, me in at.items()], *[F.col(f"{me}_text").alias(f"{c}_text") for c, me in at.items() if texts])


# ---- nested languages

#: host language: {element whose raw text is another language: that language}
EMBEDDED = {"html": {"script_element": "javascript", "style_element": "css"}}


def injection_query(embedded: dict[str, str]) -> str:
    """A query that takes the raw text of elements for other languages."""
    return "\n".join(f'(({element} (raw_text) @injection.content) (#set! injection.language "{language}"))' for element, language in embedded.items())


#: host language: its injection query; callers may give others.
INJECTIONS = {language: injection_query(own) for language, own in EMBEDDED.items()}


def _document_spans(spans: list[tuple[int, int]], shift: list[tuple[int, int]] | None, length: int) -> list[tuple[int, int]]:
    """Spans of a text that was put together, as ranges of the document: cut where its pieces are."""
    if shift is None:
        return spans
    ends = [a for a, _ in shift[1:]] + [length]
    out = []
    for a, b in spans:
        for (piece, document), end in zip(shift, ends):
            s, e = max(a, piece), min(b, end)
            if s < e:
                out.append((s - piece + document, e - piece + document))
    return out


def _layers(source: bytes, language: str, most_depth: int | None = None, injections: dict[str, str] | None = None) -> list[tuple[int, int | None, int, str, list[tuple[int, int]], Node, bytes, list | None]]:
    """(layer, parent layer, depth, language, ranges, root, own text, shift), level by level."""
    queries = INJECTIONS if injections is None else injections
    out = []
    todo = [(None, 0, language, [(0, len(source))])]
    while todo:
        parent, depth, lang, ranges = todo.pop(0)
        own, shift = _pieces(source, ranges) if parent is not None else (source, None)
        root = LANGUAGES[lang](own)
        me = len(out)
        out.append((me, parent, depth, lang, ranges, root, own, shift))
        if lang not in queries or depth == most_depth:
            continue
        matcher = _matcher(queries[lang], lang)
        q = matcher.query
        combined: dict[int, tuple[str, list]] = {}
        below: list[tuple[str, list]] = []
        for m in matcher.matches(root, own):
            settings = q.patterns[m.pattern].settings()
            named = [own[n.start : n.end].decode("utf-8", "replace") for c, n in m.captures if c == "injection.language"]
            to = named[0] if named else settings.get("injection.language") or (lang if "injection.self" in settings else out[parent][3] if "injection.parent" in settings and parent is not None else None)
            content = [n for c, n in m.captures if c == "injection.content"]
            if to not in LANGUAGES or not content:
                continue  # a language that is not known is skipped
            spans = _document_spans([s for n in content for s in content_ranges(n, "injection.include-children" in settings)], shift, len(own))
            if "injection.combined" in settings:
                combined.setdefault(m.pattern, (to, []))[1].extend(spans)
            else:
                below.append((to, spans))
        for to, spans in below + [(to, sorted(spans)) for to, spans in combined.values()]:
            if spans and (to, spans) != (lang, ranges):  # a layer that holds itself ends there
                todo.append((me, depth + 1, to, spans))
    return out


def content_ranges(node: Node, include_children: bool) -> list[tuple[int, int]]:
    """A node's range without its children's, unless they are included."""
    if include_children or not node.children:
        return [(node.start, node.end)]
    out, at = [], node.start
    for c in node.children:
        if c.start > at:
            out.append((at, c.start))
        at = c.end
    return out + ([(at, node.end)] if node.end > at else [])


def layers(df: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text", most_depth: int | None = None, injections: dict[str, str] | None = None) -> DataFrame:
    """(id, layer_id, parent_layer, depth, language, ranges) of every text, its own language and those nested in it, by start and depth.

    injections: {language: its injection query}; all depths, unless most_depth is given.
    """

    def one(i, source):
        for me, parent, depth, lang, ranges, *_ in sorted(_layers(source, language, most_depth, injections), key=lambda x: (x[4][0][0] if x[4] else 0, x[2])):
            yield i, me, parent, depth, lang, [{"start": a, "end": b} for a, b in ranges]

    return _each_text(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, layer_id int, parent_layer int, depth int, language string, ranges array<struct<start:int,end:int>>", one)


def layered_nodes(df: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text", most_depth: int | None = None, injections: dict[str, str] | None = None, kinds: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """parse() with the nodes of nested languages as layers of their own."""
    schema, names = _node_schema(columns)
    wanted = None if kinds is None else frozenset(kinds)

    def one(i, source):
        out: list[list] = [[] for _ in names]
        for me, _, _, lang, _, root, own, shift in _layers(source, language, most_depth, injections):
            for column, more in zip(out, node_columns(root, own, me, lang, names, shift, wanted, source)):
                column.extend(more)
        n = len(out[0])
        return n, [[i] * n, *out]

    return _each_columns(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, {schema}", one)


def overlaid(df: DataFrame, language: str, inner: str, mark: str, id_col: str = "doc_id", text_col: str = "text", injections: dict[str, str] | None = None) -> DataFrame:
    """(id, text): every text with each byte of the layers of a nested language replaced by one mark, so that offsets stay."""
    fill = mark.encode("utf-8")
    if len(fill) != 1:
        raise ValueError("a mark is one byte")

    def one(i, source):
        spans = [(a, b, fill * (b - a)) for _, _, _, lang, ranges, *_ in _layers(source, language, None, injections) if lang == inner for a, b in ranges]
        yield i, replaced(source, spans).decode("utf-8", "replace")

    return _each_text(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, text string", one)


def replaced(source: bytes, spans: list[tuple[int, int, bytes]]) -> bytes:
    """The text with spans overlaid by texts of their lengths."""
    out = bytearray(source)
    for a, b, new in spans:
        if len(new) != b - a:
            raise ValueError("a replacement has the length of what it replaces")
        out[a:b] = new
    return bytes(out)


# ---- scopes


def resolve(references: DataFrame, definitions: DataFrame, scopes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each reference (id, name, offset) with the definition (id, name, offset as def_offset) that it means, or null.

    scopes: (id, scope_start, scope_end, inherits). Candidates are definitions of the name before the reference in a scope
    that holds it; the innermost scope wins, then the latest definition. A scope that does not inherit hides those outside.
    """
    d = definitions.select(id_col, "name", F.col("offset").alias("def_offset"))
    s = scopes.select(id_col, "scope_start", "scope_end", "inherits")
    inside = d.join(s, id_col).where("def_offset >= scope_start and def_offset < scope_end")
    own = inside.groupBy(id_col, "name", "def_offset").agg(F.max_by(F.struct("scope_start", "scope_end"), F.struct("scope_start", -F.col("scope_end"))).alias("o")).select(id_col, "name", "def_offset", "o.*")
    walls = references.select(id_col, "name", "offset").distinct().join(s.where("not inherits"), id_col).where("offset >= scope_start and offset < scope_end").groupBy(id_col, "name", "offset").agg(F.max("scope_start").alias("wall"))
    met = references.join(own, [id_col, "name"]).where("def_offset <= offset and offset >= scope_start and offset < scope_end").join(walls, [id_col, "name", "offset"], "left").where("wall is null or scope_start >= wall")
    best = met.groupBy(id_col, "name", "offset").agg(F.max_by("def_offset", F.struct("scope_start", -F.col("scope_end"), "def_offset")).alias("def_offset"))
    return references.join(best, [id_col, "name", "offset"], "left")


def _meant(scopes: list, definitions: list, references: list) -> dict[tuple[str, int], int]:
    """{(name, offset) of a reference: the offset of the definition that it means}, as resolve() has it."""
    inside = lambda at: [(a, b, more) for a, b, more in scopes if a <= at < b]
    own: dict[str, list[tuple[int, int, int]]] = {}
    for name, at in definitions:
        held = [(a, -b) for a, b, _ in inside(at)]
        if held:
            a, b = max(held)
            own.setdefault(name, []).append((a, b, at))
    out = {}
    for name, at in references:
        if name in own:
            wall = max((a for a, _, more in inside(at) if not more), default=-1)
            fit = [(a, b, d) for a, b, d in own[name] if d <= at and a <= at < -b and a >= wall]
            if fit:
                out[name, at] = max(fit)[2]
    return out


def resolved(df: DataFrame, language: str, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, offset, def_offset): resolve() of scoped_names(), in the pass that parses, as a text's scopes hold nothing of another's. Ids are not repeated."""
    parser = LANGUAGES[language]
    compiled(query, language)

    def one(i, source):
        scopes, definitions, references = _scoped(parser(source), source, query, language)
        meant = _meant(scopes, definitions, references)
        for name, at in references:
            yield i, name, at, meant.get((name, at))

    return _each_text(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, name string, offset int, def_offset int", one)


# ---- highlighting

#: language: {capture: patterns}, later ones winning on the same node.
COLOURS = {
    "json": {"string": ["(string)"], "property": ["(pair key: (string) @@)"], "constant": ["(number)", "(true)", "(false)", "(null)"], "escape": ["(escape_sequence)"], "comment": ["(comment)"]},
    "html": {"tag": ["(tag_name)"], "attribute": ["(attribute_name)"], "string": ["(attribute_value)"], "constant": ["(doctype)", "(entity)"], "comment": ["(comment)"]},
    "sql": {"variable": ["(identifier)", "(quoted_identifier)"], "keyword": ["(keyword)"], "string": ["(string)"], "constant": ["(number)"], "comment": ["(comment)"]},
    "css": {"property": ["(identifier)"], "constant": ["(number)"], "comment": ["(comment)"]},
    "code": {"variable": ["(identifier)"], "function": ["(identifier) @@ . (arguments)"], "string": ["(string)"], "constant": ["(number)"], "comment": ["(comment)"]},
}
COLOURS["javascript"] = COLOURS["code"]


def highlight_query(colours: dict[str, list[str]]) -> str:
    """A query from patterns by capture; @@ marks the node that gets it, else the pattern's own does."""
    out = []
    for capture, patterns in colours.items():
        for p in patterns:
            own = p.replace("@@", f"@{capture}") if "@@" in p else f"{p} @{capture}"
            out.append(f"({own})" if " . " in p else own)
    return "\n".join(out)


#: language: its highlight query; callers may give others.
HIGHLIGHTS = {language: highlight_query(own) for language, own in COLOURS.items()}


def recognised(capture: str, names: list[str]) -> str | None:
    """Of names the one with the most dotted parts, all of which the capture has."""
    parts = capture.split(".")
    fit = [n for n in names if all(p in parts for p in n.split("."))]
    return max(fit, key=lambda n: len(n.split(".")), default=None)


def highlight(df: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text", names: list[str] | None = None, highlights: dict[str, str] | None = None, injections: dict[str, str] | None = None, scopes: dict[str, str] | None = None, texts: bool = False) -> DataFrame:
    """(id, seq, layer_id, start_byte, end_byte, capture), with texts also the span's text: spans in order of the text, outer before inner, deeper layers later.

    highlights and injections: {language: its query}. Of several patterns on one node the last counts, and of layers
    with one range the first. scopes: {language: a query of scopes}; a pattern with (#is-not? local) is then skipped on
    a name that is defined in a scope around it, and one with (#is? local) counts there alone.
    """
    queries = HIGHLIGHTS if highlights is None else highlights

    def one(i, source):
        spans: dict[tuple[int, int], tuple] = {}
        for me, _, depth, lang, _, root, own, shift in _layers(source, language, None, injections):
            if lang not in queries:
                continue
            matcher = _matcher(queries[lang], lang)
            local = _local_names(root, own, scopes[lang], lang) if scopes and lang in scopes else frozenset()
            best: dict[int, tuple[int, str, Node]] = {}
            for m in matcher.matches(root, own):
                wanted = [positive for positive, name in matcher.query.patterns[m.pattern].assertions() if name == "local"]
                for c, n in m.captures:
                    if all((n.start in local) == positive for positive in wanted) and (id(n) not in best or best[id(n)][0] <= m.pattern):
                        best[id(n)] = (m.pattern, c, n)
            for _, c, n in best.values():
                name = c if names is None else recognised(c, names)
                if name is not None:
                    spans.setdefault((placed(shift, n.start), placed(shift, n.end, True)), (depth, me, name))
        for seq, ((a, b), (_, me, name)) in enumerate(sorted(spans.items(), key=lambda x: (x[0][0], -x[0][1], x[1][0]))):
            yield (i, seq, me, a, b, name, source[a:b].decode("utf-8", "replace")) if texts else (i, seq, me, a, b, name)

    return _each_text(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, seq int, layer_id int, start_byte int, end_byte int, capture string" + ", text string" * texts, one)


def _scoped(root: Node, source: bytes, query: str, language: str) -> tuple[list, list, list]:
    """(scopes as (start, end, inherits), definitions as (name, offset), references as (name, offset)) by @scope, @definition and @reference."""
    matcher = _matcher(query, language)
    scopes, definitions, references = [], [], []
    for m in matcher.matches(root, source):
        settings = matcher.query.patterns[m.pattern].settings()
        for c, n in m.captures:
            text = source[n.start : n.end].decode("utf-8", "replace")
            if c == "scope":
                scopes.append((n.start, n.end, settings.get("inherits") != "false"))
            elif c == "definition":
                definitions.append((text, n.start))
            elif c == "reference":
                references.append((text, n.start))
    return sorted(set(scopes)), sorted(set(definitions)), sorted(set(references))


def _local_names(root: Node, source: bytes, query: str, language: str) -> frozenset[int]:
    """Where names stand that are defined before in a scope that holds them."""
    scopes, definitions, references = _scoped(root, source, query, language)
    held = {at for _, at in definitions if any(a <= at < b for a, b, _ in scopes)}
    return frozenset(held | {at for _, at in _meant(scopes, definitions, references)})


def scoped_names(df: DataFrame, language: str, query: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, definitions, scopes) for resolve(), by a query with @scope, @definition and @reference; (#set! inherits "false") closes a scope."""
    parser = LANGUAGES[language]
    compiled(query, language)

    def one(i, source):
        scopes, definitions, references = _scoped(parser(source), source, query, language)
        for a, b, more in scopes:
            yield i, "scope", None, a, b, more
        for what, found in (("definition", definitions), ("reference", references)):
            for name, at in found:
                yield i, what, name, at, None, None

    each = _each_text(df, id_col, text_col, f"`{id_col}` {_kind(df, id_col)}, what string, name string, a int, b int, inherits boolean", one)
    named = lambda what: each.where(F.col("what") == what).select(id_col, "name", F.col("a").alias("offset"))
    return named("reference"), named("definition"), each.where("what = 'scope'").select(id_col, F.col("a").alias("scope_start"), F.col("b").alias("scope_end"), "inherits")


#: language: a query whose @definition.x and @reference.x stand for what the @name beside them does.
TAGS = {"json": "(pair key: (string (string_content) @name)) @definition.property"}
TAGS["code"] = '("function" . (identifier) @name @definition.function)\n("class" . (identifier) @name @definition.class)\n((identifier) @name @reference.call . (arguments))'
TAGS["javascript"] = TAGS["code"]


def tags(df: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text", query: str | None = None) -> DataFrame:
    """(id, name, role, tag, start_byte, end_byte): what is defined and what is referred to, by a query of tags."""
    query = TAGS[language] if query is None else query
    m = query_texts(df, language, query, id_col, text_col)
    name = F.get(F.filter("captures", lambda c: c["name"] == "name"), 0)
    what = F.get(F.filter("captures", lambda c: c["name"].rlike("^(definition|reference)(\\.|$)")), 0)
    each = m.select(id_col, name.alias("n"), what.alias("w")).where("n is not null and w is not null")
    return each.select(id_col, F.col("n.text").alias("name"), F.substring_index("w.name", ".", 1).alias("role"), F.regexp_extract("w.name", r"\.(.*)", 1).alias("tag"), F.col("n.start_byte").alias("start_byte"), F.col("n.end_byte").alias("end_byte")).distinct()


def highlight_events(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, kind, offset, capture): start and end events of spans, ends before starts at one place and inner ends first."""
    start = spans.select(id_col, F.col("start_byte").alias("offset"), F.lit(1).alias("_o"), (-F.col("end_byte")).alias("_p"), F.lit("start").alias("kind"), "capture")
    end = spans.select(id_col, F.col("end_byte").alias("offset"), F.lit(0).alias("_o"), (-F.col("start_byte")).alias("_p"), F.lit("end").alias("kind"), "capture")
    w = Window.partitionBy(id_col).orderBy("offset", "_o", "_p", "capture")
    return start.unionAll(end).withColumn("seq", F.row_number().over(w)).drop("_o", "_p")


def styled(spans: DataFrame, styles: DataFrame, default: str = "default") -> DataFrame:
    """spans with the style of the longest dotted prefix of their capture, or the default; styles: (name, style)."""
    parts = F.split("capture", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    names = spans.select("capture").distinct().withColumn("name", F.explode(prefixes))
    known = names.join(small(styles), "name").groupBy("capture").agg(F.max_by("style", F.length("name")).alias("style"))
    return spans.join(small(known), "capture", "left").withColumn("style", F.coalesce("style", F.lit(default)))


def nearest_colours(colours: DataFrame, palette: DataFrame) -> DataFrame:
    """(r, g, b) with the palette entry (index, pr, pg, pb) of the least squared distance; a palette of over 256 entries is refused, so that its one row is small."""
    if palette.limit(257).count() > 256:
        raise ValueError("a palette has 256 entries at most")
    p = palette.agg(F.collect_list(F.struct("index", "pr", "pg", "pb")).alias("_p"))  # one row
    each = colours.join(F.broadcast(p)).withColumn("_best", F.array_min(F.transform("_p", lambda x: F.struct(((F.col("r") - x["pr"]) ** 2 + (F.col("g") - x["pg"]) ** 2 + (F.col("b") - x["pb"]) ** 2).alias("d"), x["index"].alias("index")))))
    return each.withColumn("index", F.col("_best.index")).drop("_p", "_best")


def ansi_palette(spark) -> DataFrame:
    """The 16 colours of a terminal, by rule: a bit each of red, green and blue, dark and bright, with two greys between."""
    own = [(k, *(128 * (k >> bit & 1) for bit in range(3))) for k in range(7)] + [(7, 192, 192, 192), (8, 128, 128, 128)]
    return spark.createDataFrame(own + [(8 + k, *(255 * (k >> bit & 1) for bit in range(3))) for k in range(1, 8)], "index int, pr int, pg int, pb int")


def xterm_palette(spark) -> DataFrame:
    """The 6 x 6 x 6 cube and the greys of the 256-colour palette, by rule."""
    steps = [0, *range(95, 256, 40)]
    cube = [(16 + 36 * r + 6 * g + b, steps[r], steps[g], steps[b]) for r in range(6) for g in range(6) for b in range(6)]
    greys = [(232 + k, 8 + 10 * k, 8 + 10 * k, 8 + 10 * k) for k in range(24)]
    return spark.createDataFrame(cube + greys, "index int, pr int, pg int, pb int")


# ---- change


def edited(nodes: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Nodes after an edit a document: (id, start, old_end, new_end). Nodes behind it move, nodes that touch it are marked changed."""
    e = edits.select(id_col, F.col("start").alias("_s"), F.col("old_end").alias("_o"), F.col("new_end").alias("_n"))
    d = nodes.join(e, id_col, "left")
    move = lambda c: F.when(F.col("_s").isNull() | (F.col(c) < F.col("_s")), F.col(c)).when(F.col(c) >= F.col("_o"), F.col(c) + F.col("_n") - F.col("_o")).otherwise(F.least(F.col(c), F.col("_n")))
    changed = F.coalesce((F.col("start_byte") <= F.col("_o")) & (F.col("end_byte") >= F.col("_s")), F.lit(False))
    return d.withColumn("has_changes", changed).withColumn("start_byte", move("start_byte")).withColumn("end_byte", move("end_byte")).drop("_s", "_o", "_n")


def _text_pairs(old: DataFrame, new: DataFrame, id_col: str, text_col: str, more: list[Column] = ()) -> DataFrame:
    """(id, _old, _new, *more of new): the texts of an id side by side, dealt over the cores; null texts have no pair."""
    spark = old.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # texts are small, parsing is not
    a, b = old.select(id_col, F.col(text_col).alias("_old")).where("_old is not null"), new.select(id_col, F.col(text_col).alias("_new"), *more)
    return a.repartition(n, id_col).join(_sorted_join(b.repartition(n, id_col)), id_col)


def equal_nodes(left: DataFrame, right: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, same): how many nodes of the two texts of an id are equal: in number, kind and bytes. The texts are joined and not their nodes; texts without a common node give no row."""
    parser = LANGUAGES[language]
    key = ["node_id", "kind", "start_byte", "end_byte"]

    def one(i, after, before):
        before = before if isinstance(before, bytes) else before.encode("utf-8")
        same = sum(x == y for x, y in zip(*[zip(*node_columns(parser(t), t, 0, language, key)) for t in (before, after)]))
        if same:
            yield i, same

    each = _each_text(_text_pairs(left, right, id_col, text_col), id_col, "_new", f"`{id_col}` {_kind(left, id_col)}, same bigint", one, ["_old"])
    return each.groupBy(id_col).agg(F.sum("same").alias("same"))


def changed_ranges(old: DataFrame, new: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text", edit_cols: tuple[str, str, str] | None = None) -> DataFrame:
    """(id, start, end): the ranges of each new text whose nodes the old tree, after the edit, does not have.

    The texts of an id are parsed and compared in one task, so that texts are joined and not nodes. The edit is what
    stands between the longest common start and end, or columns of new that say where it starts, where it ended and
    where it ends. Ids of one side alone give no rows; of a repeated id each pair is compared.
    """
    parser = LANGUAGES[language]
    more = [F.col(c).cast("int").alias(f"_e{k}") for k, c in enumerate(edit_cols or ())]
    both = _text_pairs(old, new, id_col, text_col, more)

    def one(i, after, before, *edit):
        before = before if isinstance(before, bytes) else before.encode("utf-8")
        for a, b in changed(parser, before, after, edit or None):
            yield i, a, b

    return _each_text(both, id_col, "_new", f"`{id_col}` {_kind(old, id_col)}, start int, end int", one, ["_old", *[f"_e{k}" for k in range(len(more))]])


def to_parse_again(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of new whose text differs from old's, by a hash of it: all that an incremental run parses."""
    seen = old.select(id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("_h"))
    return new.withColumn("_h", F.sha2(F.col(text_col).cast("binary"), 256)).join(seen, [id_col, "_h"], "left_anti").drop("_h")


# ---- catalogue


def _types(base: DataFrame, below: DataFrame) -> DataFrame:
    """base: (language, kind, is_named, n, supertypes); below: (language, kind, fields, child_kinds) of parents; both may repeat."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    own = base.groupBy("language", "kind", "is_named").agg(F.sum("n").alias("n"), F.first("supertypes").alias("supertypes"))
    return own.join(below.groupBy("language", "kind").agg(flat("fields"), flat("child_kinds")), ["language", "kind"], "left").select("language", "kind", "is_named", "n", "supertypes", "fields", "child_kinds")


def node_types(nodes: DataFrame) -> DataFrame:
    """(language, kind, is_named, n, supertypes, fields, child_kinds) as they occur: what a language's node types look like in data."""
    p = parents(nodes.select(*_key(nodes.columns[0]), "node_id", "parent_id", "kind", "field", "language"), nodes.columns[0], ["kind", "language"])
    below = p.groupBy(F.col("parent_language").alias("language"), F.col("parent_kind").alias("kind")).agg(F.collect_set("field").alias("fields"), F.collect_set("kind").alias("child_kinds"))
    return _types(nodes.groupBy("language", "kind", "is_named").agg(F.count("*").alias("n"), F.first("supertypes").alias("supertypes")), below)


#: Node types that a task counts before it hands them on.
TYPES_HELD = 10_000


def node_types_of(df: DataFrame, language: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """node_types() of all texts, counted in the pass that parses: a task gives a row a type, so that no node is shuffled."""
    parser = LANGUAGES[language]
    kind = _parse_datatype_string("kind string, is_named boolean, n bigint, supertypes array<string>, fields array<string>, child_kinds array<string>")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: dict[tuple[str, bool], list] = {}
        below: dict[str, tuple[set, set]] = {}

        def flush():
            out = [(k, named, n, list(sup), None, None) for (k, named), (n, sup) in base.items()] + [(k, None, None, None, sorted(f), sorted(c)) for k, (f, c) in below.items()]
            base.clear(), below.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*out), arrow)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(at, 64).to_pylist():
                    if text is None:
                        continue
                    for n in walk(parser(text if isinstance(text, bytes) else text.encode("utf-8"))):
                        held = base.get((n.kind, n.named))
                        if held is None:
                            base[n.kind, n.named] = [1, n.supertypes]
                        else:
                            held[0] += 1
                        if n.children:
                            fields, kinds = below.setdefault(n.kind, (set(), set()))
                            fields.update(c.field for c in n.children if c.field is not None)
                            kinds.update(c.kind for c in n.children)
                    if len(base) > TYPES_HELD:
                        yield flush()
        if base:
            yield flush()

    each = cut(spread(df.select(text_col)).mapInArrow(run, kind)).withColumn("language", F.lit(language))
    return _types(each.where("n is not null"), each.where("n is null"))


def symbols(spark) -> DataFrame:
    """(language, symbol, name): the kinds of named nodes that each parser makes, numbered in order of their names."""
    return spark.createDataFrame([(lang, k, name) for lang, own in sorted(KINDS.items()) for k, name in enumerate(sorted(own))], "language string, symbol int, name string")


def field_names(spark) -> DataFrame:
    """(language, field, name), numbered from 1."""
    return spark.createDataFrame([(lang, k + 1, name) for lang, own in sorted(FIELDS.items()) for k, name in enumerate(sorted(own))], "language string, field int, name string")


def expected_next(nodes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(language, kind, next_kind, n): which leaf follows which, as a table for completion."""
    w = Window.partitionBy(*_key(id_col)).orderBy("node_id")
    leaves = nodes.where("n_children = 0").withColumn("next_kind", F.lead("kind").over(w))
    return leaves.where("next_kind is not null").groupBy("language", "kind", "next_kind").agg(F.count("*").alias("n"))


