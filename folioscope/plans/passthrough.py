"""SQL as users write it: run over the stored tables, with the words of other dialects put into Spark's.

Strings, quoted names and comments are left as they are; outside of them functions and operators that Spark
calls otherwise are renamed.  ``"name"`` is a column, and ``LIKE`` takes no notice of case, as users of
embedded databases expect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_PIECE = re.compile(r"""('(?:[^']|'')*')|("(?:[^"]|"")*")|(`[^`]*`)|(--[^\n]*|/\*.*?\*/)|([A-Za-z_][A-Za-z_0-9]*)|(\s+)|(->>|->|\|\||.)""", re.DOTALL)

#: Functions that only go by another name.
RENAMED = {"iif": "if", "group_concat": "listagg", "json_extract": "get_json_object", "printf": "format_string", "datetime": "to_timestamp", "unixepoch": "unix_timestamp", "total_changes": "0"}
#: Functions with one argument that are expressions in Spark.
WRITTEN = {
    "json_group_array": "to_json(collect_list({}))", "total": "coalesce(cast(sum({}) as double), 0.0D)", "julianday": "(unix_timestamp(to_timestamp({})) / 86400.0D + 2440587.5D)",
    "json_array_length": "json_array_length({})", "date": "to_date({})",
}
#: Letters of ``strftime`` patterns in Spark's.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%%": "%"}


def _pieces(sql: str) -> list[tuple[str, str]]:
    kinds = ("string", "name", "name", "comment", "word", "blank", "mark")
    out = []
    for m in _PIECE.finditer(sql):
        out.append((kinds[m.lastindex - 1], m[0]))
    return out


def _closing(parts: list[tuple[str, str]], at: int) -> int:
    """Where the bracket that opens at ``at`` closes."""
    depth = 0
    for i in range(at, len(parts)):
        if parts[i] == ("mark", "("):
            depth += 1
        elif parts[i] == ("mark", ")"):
            depth -= 1
            if not depth:
                return i
    raise ValueError("a bracket is not closed")


def _pattern(text: str) -> str:
    """A ``strftime`` pattern in Spark's letters."""
    return "'" + re.sub("%.", lambda m: STRFTIME.get(m[0], m[0]), text[1:-1]) + "'"


def _glob(text: str) -> str:
    """A ``GLOB`` pattern as a regular expression."""
    body = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]-^" or c.isalnum() else re.escape(c)) for c in text[1:-1])
    return "r'(?s)^" + body.replace("'", "''") + "$'"


def translate(sql: str) -> str:
    """``sql`` in Spark's dialect."""

    def write(parts: list[tuple[str, str]]) -> str:
        out, i = [], 0
        while i < len(parts):
            kind, text = parts[i]
            ahead = i + 1
            while ahead < len(parts) and parts[ahead][0] == "blank":
                ahead += 1
            called = kind == "word" and ahead < len(parts) and parts[ahead] == ("mark", "(")
            low = text.lower()
            if kind == "name" and text[0] == '"':
                out.append("`" + text[1:-1].replace('""', '"').replace("`", "``") + "`")
            elif called and (low in WRITTEN or low == "strftime"):
                end = _closing(parts, ahead)
                inside = parts[ahead + 1 : end]
                if low == "strftime":
                    comma = next((k for k, p in enumerate(inside) if p == ("mark", ",")), None)
                    first = next((p for p in inside if p[0] != "blank"), ("", ""))
                    if comma is None or first[0] != "string":
                        raise ValueError("strftime needs a constant pattern and a time")
                    out.append(f"date_format(to_timestamp({write(inside[comma + 1 :])}), {_pattern(first[1])})")
                else:
                    out.append(WRITTEN[low].format(write(inside)))
                i = end + 1
                continue
            elif called and low in RENAMED:
                out.append(RENAMED[low])
            elif kind == "word" and low == "like" and not called:
                out.append("ILIKE")
            elif kind == "word" and low == "glob" and not called:
                if ahead >= len(parts) or parts[ahead][0] != "string":
                    raise ValueError("GLOB needs a constant pattern")
                out.append(f"RLIKE {_glob(parts[ahead][1])}")
                i = ahead + 1
                continue
            elif kind == "word" and low == "regexp" and not called:
                out.append("RLIKE")
            elif text in ("->>", "->"):
                out.append(":" if ahead < len(parts) and parts[ahead][0] == "word" else text)
            else:
                out.append(text)
            i += 1
        return "".join(out)

    return write(_pieces(sql))


def query(spark: SparkSession, sql: str, views: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The result of one statement and its columns with their types; ``views`` are the tables it may name.

    A wrong statement raises Spark's own error.
    """
    for name, rows in (views or {}).items():
        rows.createOrReplaceTempView(name)
    out = spark.sql(translate(sql))
    return out, out.dtypes


def columns(rows: DataFrame) -> list[tuple[str, str]]:
    return rows.dtypes
