"""Scalar forms that Spark SQL writes differently or lacks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def element(c: Column, i: int) -> Column:
    """c[i] from 1, from the end if negative; null outside."""
    return F.try_element_at(c, F.lit(i))


def slice_list(c: Column, start: int | None = None, end: int | None = None, step: int = 1) -> Column:
    """c[start:end:step], from 1 and with both ends, negative ones counted from the end; a negative step goes backwards."""
    n = F.size(c)
    at = lambda i, default: default if i is None else F.lit(i) if i > 0 else n + i + 1 if i < 0 else F.lit(0)
    lo = F.greatest(at(start, F.lit(1)), F.lit(1))
    hi = F.least(at(end, n), n)
    part = F.slice(c, lo, F.greatest(hi - lo + 1, F.lit(0)))
    if step == 1:
        return part
    if step < 0:
        part = F.reverse(part)
    k = abs(step)
    return F.filter(part, lambda x, i: i % k == 0)


def comprehension(c: Column, each: Callable[[Column], Column], condition: Callable[[Column], Column] | None = None) -> Column:
    """[each(x) FOR x IN c IF condition(x)]"""
    return F.transform(F.filter(c, condition) if condition else c, each)


def glob_regex(pattern: str) -> str:
    """A GLOB pattern as a regular expression of the whole string: * ? [a-z] [!a]."""
    out, k = [], 0
    while k < len(pattern):
        ch = pattern[k]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and (end := pattern.find("]", k + 2)) > 0:
            body = pattern[k + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]")
            k = end
        else:
            out.append(re.escape(ch))
        k += 1
    return "(?s)^" + "".join(out) + "$"


def similar_regex(pattern: str) -> str:
    """A SIMILAR TO pattern as a regular expression of the whole string: % and _ stand for .* and ."""
    return "(?s)^(?:" + re.sub(r"\\.|%|_|\.", lambda m: {"%": ".*", "_": ".", ".": r"\."}.get(m[0], m[0]), pattern) + ")$"


def glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def similar_to(c: Column, pattern: str) -> Column:
    return c.rlike(similar_regex(pattern))


def between_symmetric(c: Column, a: Column, b: Column) -> Column:
    return c.between(F.least(a, b), F.greatest(a, b))


def any_of(c: Column, op: str, values: Column) -> Column:
    """c op ANY (array)"""
    return F.exists(values, lambda x: compare(c, op, x))


def all_of(c: Column, op: str, values: Column) -> Column:
    """c op ALL (array)"""
    return F.forall(values, lambda x: compare(c, op, x))


def compare(a: Column, op: str, b: Column) -> Column:
    """A comparison, arithmetic or text operator by its token."""
    forms = {
        "=": lambda: a == b, "==": lambda: a == b, "<>": lambda: a != b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "<=>": lambda: a.eqNullSafe(b),
        "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "//": lambda: F.floor(a / b), "%": lambda: a % b, "**": lambda: F.pow(a, b), "||": lambda: F.concat(a, b),
        "&": lambda: a.bitwiseAND(b), "|": lambda: a.bitwiseOR(b), "#": lambda: a.bitwiseXOR(b), "~": lambda: F.regexp_like(a, b), "!~": lambda: ~F.regexp_like(a, b), "~~": lambda: F.like(a, b), "!~~": lambda: ~F.like(a, b), "~~*": lambda: F.ilike(a, b), "^@": lambda: a.startswith(b), "@>": lambda: F.size(F.array_except(b, a)) == 0, "<@": lambda: F.size(F.array_except(a, b)) == 0, "&&": lambda: F.arrays_overlap(a, b),
    }
    if op not in forms:
        raise ValueError(f"no operator {op}")
    return forms[op]()


def member_of(c: Column, values: Column) -> Column:
    return F.array_contains(values, c)


def submultiset(a: Column, b: Column) -> Column:
    """Whether b has each element of a at least as often as a."""
    count = lambda arr, v: F.size(F.filter(arr, lambda y: y == v))
    return F.forall(F.array_distinct(a), lambda v: count(a, v) <= count(b, v))


def is_json(c: Column) -> Column:
    return F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False)) & c.isNotNull()


def at_time_zone(c: Column, zone: str, source: str = "UTC") -> Column:
    """A local timestamp of one zone in another."""
    return F.convert_timezone(F.lit(source), F.lit(zone), c)


def json_value(c: Column, path: str, kind: str = "string") -> Column:
    return F.get_json_object(c, path).cast(kind)


def json_exists(c: Column, path: str) -> Column:
    return F.get_json_object(c, path).isNotNull()


def match_against(c: Column, words: list[str], every: bool = False) -> Column:
    """Full-text match without an index: any (or every) of the words among the text's words."""
    own = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    tests = [F.array_contains(own, w.lower()) for w in words]
    out = tests[0]
    for t in tests[1:]:
        out = (out & t) if every else (out | t)
    return out


#: Names of other dialects and the Spark function that each means.
FUNCTION_NAMES = {
    "list_value": "array", "list_contains": "array_contains", "list_has": "array_contains", "list_sort": "array_sort", "list_distinct": "array_distinct", "list_concat": "concat", "list_aggregate": "aggregate", "len": "size", "strlen": "octet_length", "array_length": "size", "cardinality": "size",
    "unnest": "explode", "string_split": "split", "strpos": "instr", "string_agg": "listagg", "group_concat": "listagg", "arg_max": "max_by", "arg_min": "min_by", "argMax": "max_by", "argMin": "min_by", "uniq": "approx_count_distinct", "uniqExact": "count_distinct", "quantile": "percentile_approx", "groupArray": "collect_list", "groupUniqArray": "collect_set", "array_agg": "collect_list",
    "approx_distinct": "approx_count_distinct", "approx_percentile": "percentile_approx", "bool_and": "bool_and", "bool_or": "bool_or", "logical_and": "bool_and", "logical_or": "bool_or", "toStartOfMonth": "trunc", "today": "current_date", "now": "current_timestamp", "getdate": "current_timestamp", "sysdate": "current_timestamp", "isnull": "isnull", "ifnull": "ifnull", "nvl": "nvl", "iif": "if", "datediff": "datediff", "dateadd": "dateadd",
    "to_char": "to_char", "instr": "instr", "substr": "substr", "charindex": "locate", "lcase": "lower", "ucase": "upper", "length": "length", "regexp_matches": "regexp_like", "regexp_extract": "regexp_extract", "json_extract": "get_json_object", "JSON_VALUE": "get_json_object", "epoch": "unix_timestamp", "from_unixtime": "from_unixtime", "struct_pack": "named_struct", "map_from_entries": "map_from_entries", "generate_series": "sequence", "range": "sequence",
}


def call(name: str, *args: Column) -> Column:
    """A function by its name in any dialect."""
    return F.call_function(FUNCTION_NAMES.get(name, name), *args)


def method(c: Column, name: str, *args: Column) -> Column:
    """x.f(a) as f(x, a)."""
    return call(name, c, *args)
