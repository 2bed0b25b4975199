"""Row-pattern matching (MATCH_RECOGNIZE).

A row becomes one character that says which DEFINE conditions it meets, a partition one string of these, and the
pattern a regular expression over them whose groups are the pattern's variables. Only that character and the row number
are gathered for a partition, a few bytes a row; the rows themselves are joined to the places that match.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A row's conditions are a bit mask, shown as the character at this place plus the mask.
BASE = 0x4E00
TOKEN = regex.compile(r"\s*(\{-|-\}|PERMUTE|[A-Za-z_]\w*|\(|\)|\||\{\d*,?\d*\}|[*+?^$]|,)")
#: The group of rows that are matched and left out.
OUT = "_out"


def variables(pattern: str) -> list[str]:
    """The names in a pattern, in order of their first place."""
    return list(dict.fromkeys(t for t in _tokens(pattern) if (t[0].isalpha() or t[0] == "_") and t != "PERMUTE"))


def _tokens(pattern: str) -> list[str]:
    tokens, at = [], 0
    while at < len(pattern.rstrip()):
        m = TOKEN.match(pattern, at)
        if m is None:
            raise ValueError(f"pattern: {pattern[at:]!r}")
        tokens.append(m[1])
        at = m.end()
    return tokens


def compile_pattern(pattern: str, names: list[str]) -> str:
    """A row pattern as a regular expression over masks: concatenation, |, quantifiers, PERMUTE(..), {- exclusion -}, ^ and $.

    Each variable is a group of its name, so that what it matched can be told; names: those with a condition.
    """
    masks = range(1 << len(names))

    def symbol(name: str) -> str:
        if name not in names:
            own = list(masks)  # a symbol without a definition fits every row
        else:
            k = names.index(name)
            own = [m for m in masks if m >> k & 1]
        return f"(?P<{name}>[" + "".join(chr(BASE + m) for m in own) + "])"

    tokens = _tokens(pattern)
    out, k = [], 0
    while k < len(tokens):
        t = tokens[k]
        if t == "PERMUTE":
            end = tokens.index(")", k)
            own = [symbol(x) for x in tokens[k + 2 : end] if x != ","]
            out.append("(?:" + "|".join("".join(p) for p in permutations(own)) + ")")
            k = end
        elif t in ("{-", "-}"):
            out.append(f"(?P<{OUT}>" if t == "{-" else ")")
        elif t == "(":
            out.append("(?:")
        elif t in (")", "|", "*", "+", "?", "^", "$") or t[0] == "{":
            out.append(t)
        elif t != ",":
            out.append(symbol(t))
        k += 1
    return "".join(out)


def matches(p: regex.Pattern, text: str, names: list[str], after: str, targets: frozenset[str]) -> list[tuple[int, int, list[tuple[int, str]]]]:
    """(start, end, the places that are not left out with their variables) of each match in order. Empty matches are passed over."""
    found, at = [], 0
    while at <= len(text):
        m = p.search(text, at)
        if m is None:
            break
        a, b = m.span()
        if a == b:
            at = b + 1
            continue
        name_of: dict[int, str] = {}
        for name in names:
            for s, e in m.spans(name):
                for row in range(s, e):
                    name_of[row] = name
        left_out = {row for s, e in (m.spans(OUT) if OUT in p.groupindex else ()) for row in range(s, e)}
        found.append((a, b, [(row, name_of[row]) for row in range(a, b) if row not in left_out]))
        if after == "past last row":
            at = b
        elif after == "to next row":
            at = a + 1
        else:
            rows = sorted(row for row, name in name_of.items() if name in targets)
            if not rows:
                raise ValueError(f"after match skip {after}: the variable is not in the match")
            at = rows[0] if after.startswith("to first") else rows[-1]
            if at == a:
                raise ValueError(f"after match skip {after}: that is where the match begins")
    return found


def match_recognize(df: DataFrame, partition: list[str], order: list[str], define: dict[str, Column], pattern: str, after: str = "past last row", subsets: dict[str, list[str]] | None = None, unmatched: bool = False) -> DataFrame:
    """The rows of each match with `match_no` (from 1 in a partition), `row_no`, `match_row` (from 1 in a match) and `classifier`, the variable that they matched.

    define: conditions over the columns and over `prev_<c>` and `next_<c>`, the neighbouring rows' values; variables
    without one fit any row. after: `past last row`, `to next row`, `to first V` or `to last V`, where V may be a subset;
    a skip to the row where the match began is an error. subsets: {name: its variables}; `subsets` of a row are those
    that its variable is in. unmatched: rows of no match follow with nulls. Rows under an exclusion are left out, and
    empty matches give no rows. Null keys are a partition. one_row() gives the measures of each match.
    """
    names, own, subsets = list(define), variables(pattern), subsets or {}
    for name, members in subsets.items():
        if name in own or not set(members) <= set(own):
            raise ValueError(f"subset {name}: variables of the pattern")
    words = after.split()
    if after not in ("past last row", "to next row") and (len(words) != 3 or words[:2] not in (["to", "first"], ["to", "last"]) or words[2] not in {*own, *subsets}):
        raise ValueError(f"after match skip {after}")
    target = frozenset(subsets.get(words[2], [words[2]])) if words[0] == "to" and len(words) == 3 else frozenset()
    w = Window.partitionBy(*partition).orderBy(*order)
    near = df
    asked = " ".join(str(c) for c in define.values())
    for c in df.columns:
        for name, f in ((f"prev_{c}", F.lag), (f"next_{c}", F.lead)):
            if name in asked:
                near = near.withColumn(name, f(c).over(w))
    mask = F.lit(0)
    for k, n in enumerate(names):
        mask = mask + F.when(define[n], 1 << k).otherwise(0)
    rows = near.select(*df.columns, F.row_number().over(w).alias("row_no"), mask.alias("_mask"))
    strings = rows.groupBy(*partition).agg(F.array_sort(F.collect_list(F.struct("row_no", "_mask"))).alias("_m"))
    strings = strings.select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(partition)], F.transform("_m", lambda x: x["_mask"]).alias("_m"))
    expression = compile_pattern(pattern, names)

    @F.pandas_udf("array<struct<match_no:int,row_no:int,match_row:int,classifier:string>>")
    def places(masks: pd.Series) -> pd.Series:
        p = regex.compile(expression)
        out = []
        for ms in masks:
            found = matches(p, "".join([chr(BASE + m) for m in ms]), own, after, target)
            out.append([{"match_no": k + 1, "row_no": row + 1, "match_row": row - a + 1, "classifier": name} for k, (a, _, kept) in enumerate(found) for row, name in kept])
        return pd.Series(out)

    met = strings.select(*[f"_k{k}" for k in range(len(partition))], F.inline(places("_m"))).withColumnRenamed("row_no", "_row")
    on = F.col("row_no") == F.col("_row")
    for k, c in enumerate(partition):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    out = rows.drop("_mask").join(met, on, "left" if unmatched else "inner").drop("_row", *[f"_k{k}" for k in range(len(partition))])
    if subsets:
        member = [F.when(F.col("classifier").isin(members), F.lit(name)) for name, members in sorted(subsets.items())]
        out = out.withColumn("subsets", F.array_compact(F.array(*member)))
    return out


def of(value: str, name: str) -> Column:
    """The value in rows of a variable or subset, else null: for aggregates of measures, as SUM(A.value)."""
    # a subset's rows have it in `subsets`, which one_row() makes sure of
    return F.when((F.col("classifier") == name) | F.array_contains("subsets", name), F.col(value))


def first(value: str, name: str) -> Column:
    """FIRST(name.value) of a match."""
    return F.min_by(value, F.when((F.col("classifier") == name) | F.array_contains("subsets", name), F.col("match_row")))


def last(value: str, name: str) -> Column:
    """LAST(name.value) of a match."""
    return F.max_by(value, F.when((F.col("classifier") == name) | F.array_contains("subsets", name), F.col("match_row")))


def one_row(matched: DataFrame, partition: list[str], measures: dict[str, Column]) -> DataFrame:
    """ONE ROW PER MATCH: (partition, match_no, measures); measures aggregate the rows of a match."""
    if "subsets" not in matched.columns:
        matched = matched.withColumn("subsets", F.array().cast("array<string>"))
    return matched.where("match_no is not null").groupBy(*partition, "match_no").agg(*[c.alias(n) for n, c in measures.items()])
