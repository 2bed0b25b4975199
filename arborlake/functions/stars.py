"""Star forms and column sets: expanded from the schema, before anything runs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def star_except(df: DataFrame, *names: str) -> DataFrame:
    """* EXCLUDE (names); an unknown name is an error."""
    if unknown := set(names) - set(df.columns):
        raise ValueError(f"no such column: {sorted(unknown)}")
    return df.drop(*names)


def star_replace(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """* REPLACE: columns computed anew, in their places."""
    return df.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def star_rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def star_like(df: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """* LIKE / ILIKE: the columns whose names match."""
    p = re.compile("".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern), re.I if ignore_case else 0)
    return df.select(*[c for c in df.columns if p.fullmatch(c)])


def columns(df: DataFrame, which: str | list[str] | Callable[[str], bool]) -> list[Column]:
    """COLUMNS('regex' | [names] | name -> condition)."""
    if isinstance(which, str):
        p = re.compile(which)
        return [F.col(c) for c in df.columns if p.search(c)]
    if callable(which):
        return [F.col(c) for c in df.columns if which(c)]
    return [F.col(c) for c in which]


def apply(df: DataFrame, which, f: Callable[[Column], Column], name: Callable[[str], str] = lambda c: c) -> DataFrame:
    """APPLY: f of each column of the set; the others are left out."""
    picked = columns(df, which)
    names = [c for c in df.columns if (re.search(which, c) if isinstance(which, str) else which(c) if callable(which) else c in which)]
    return df.select(*[f(c).alias(name(n)) for c, n in zip(picked, names)])


def positional(df: DataFrame, i: int) -> Column:
    """#i: the i-th column, from 1."""
    return F.col(df.columns[i - 1])


def aliased(df: DataFrame, *names: str) -> DataFrame:
    """t AS a(x, y): the first columns get new names."""
    return df.toDF(*names, *df.columns[len(names) :])
