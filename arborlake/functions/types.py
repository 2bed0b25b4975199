"""Type names of SQL dialects as Spark types."""

from __future__ import annotations

import re

#: Type names and the Spark type that holds each.
SIMPLE = {
    "tinyint": "tinyint", "int1": "tinyint", "int8": "bigint", "smallint": "smallint", "int2": "smallint", "int16": "smallint", "short": "smallint", "integer": "int", "int": "int", "int4": "int", "int32": "int", "signed": "int", "mediumint": "int", "bigint": "bigint", "int64": "bigint", "long": "bigint", "hugeint": "decimal(38,0)",
    "utinyint": "smallint", "uint8": "smallint", "usmallint": "int", "uint16": "int", "uinteger": "bigint", "uint32": "bigint", "ubigint": "decimal(20,0)", "uint64": "decimal(20,0)", "float": "float", "float4": "float", "float32": "float", "real": "float", "double": "double", "double precision": "double", "float8": "double", "float64": "double", "number": "decimal(38,10)", "numeric": "decimal(18,3)", "decimal": "decimal(18,3)", "dec": "decimal(18,3)", "money": "decimal(19,4)", "smallmoney": "decimal(10,4)",
    "boolean": "boolean", "bool": "boolean", "logical": "boolean", "varchar": "string", "varchar2": "string", "nvarchar": "string", "nvarchar2": "string", "char": "string", "nchar": "string", "bpchar": "string", "text": "string", "string": "string", "clob": "string", "nclob": "string", "fixedstring": "string", "uuid": "string", "uniqueidentifier": "string", "bit": "string", "bitstring": "string", "enum": "string", "enum8": "string", "enum16": "string", "xml": "string", "ipv4": "string", "ipv6": "string",
    "blob": "binary", "bytea": "binary", "binary": "binary", "varbinary": "binary", "raw": "binary", "bytes": "binary", "date": "date", "date32": "date", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "datetime64": "timestamp_ntz", "smalldatetime": "timestamp_ntz", "timestamp": "timestamp_ntz", "timestamp without time zone": "timestamp_ntz", "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "datetimeoffset": "timestamp", "timestamp with local time zone": "timestamp", "time": "time(6)", "time without time zone": "time(6)",
    "interval": "interval day to second", "interval year to month": "interval year to month", "interval day to second": "interval day to second", "json": "variant", "jsonb": "variant", "variant": "variant", "dynamic": "variant", "object": "variant", "super": "variant",
}
WRAPPERS = ("nullable", "lowcardinality", "simpleaggregatefunction")


class UnknownType(ValueError):
    pass


def _arguments(text: str) -> list[str]:
    """Parts between commas outside brackets and quotes."""
    out, depth, quote, start = [], 0, None, 0
    for k, c in enumerate(text):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "(<[":
            depth += 1
        elif c in ")>]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[start:k].strip())
            start = k + 1
    last = text[start:].strip()
    return [*out, last] if last else out


def spark_type(text: str) -> str:
    """A dialect's type as a Spark DDL type. Fixed array sizes, lengths and enum values are not enforced."""
    t = re.sub(r"\s+", " ", text.strip())
    if t == "Int8":
        return "tinyint"  # so written it counts bits; int8 elsewhere counts bytes
    if m := re.fullmatch(r"(.+)\[\d*\]", t):
        return f"array<{spark_type(m[1])}>"
    low = t.lower()
    m = re.fullmatch(r"([\w ]+?)\s*([(<])(.*)([)>])\s*(unsigned|with(?: local)? time zone|without time zone)?", t, re.I | re.S)
    if m is None:
        if low.endswith(" unsigned"):
            return spark_type({"tinyint": "uint8", "smallint": "uint16", "int": "uint32", "integer": "uint32", "bigint": "uint64"}.get(low[:-9], low[:-9]))
        if low.endswith(" array"):
            return f"array<{spark_type(t[:-6])}>"
        if low in SIMPLE:
            return SIMPLE[low]
        raise UnknownType(text)
    name, args, tail = m[1].strip().lower(), _arguments(m[3]), (m[5] or "").lower()
    if name in WRAPPERS:
        return spark_type(args[-1])
    if name in ("array", "list", "setof", "multiset", "table"):
        return f"array<{spark_type(args[0])}>"
    if name == "map":
        return f"map<{spark_type(args[0])},{spark_type(args[1])}>"
    if name in ("struct", "row", "tuple", "nested", "union"):
        fields = []
        for k, a in enumerate(args):
            f = re.match(r"(\"[^\"]+\"|`[^`]+`|\w+)\s*:?\s+(.+)", a, re.S) or re.match(r"(\w+):(.+)", a, re.S)
            if f and not (a.lower() in SIMPLE):
                fields.append(f"`{f[1].strip(chr(34) + '`')}`:{spark_type(f[2])}")
            else:
                fields.append(f"`_{k + 1}`:{spark_type(a)}")
        inner = f"struct<{','.join(fields)}>"
        return f"array<{inner}>" if name == "nested" else inner
    if name in ("decimal", "numeric", "dec", "number"):
        p, s = int(args[0]), int(args[1]) if len(args) > 1 else 0
        return f"decimal({p},{s})" if p <= 38 else "string"
    if re.fullmatch(r"decimal(32|64|128)", name):
        return f"decimal({ {'32': 9, '64': 18, '128': 38}[name[7:]] },{args[0]})".replace(" ", "")
    if name in ("char", "varchar") and args and args[0].isdigit():
        return f"{name}({args[0]})"
    if name == "timestamp" or name == "time":
        return spark_type(f"{name} {tail}".strip())
    if name == "aggregatefunction":
        return "binary"
    return spark_type(f"{name} {tail}".strip())
