"""Criteria text to Spark expressions.

Criteria are comparisons `column op literal` joined by and, or and parentheses.
Each comparison is rewritten to a typed SQL one; Spark's own parser does the
rest, so precedence is SQL's. Rules of the comparisons:

- a column goes by its name in any case, or by its ordinal;
- literals are text, quoted or not, and are typed once by the column: one that
  does not fit its type makes the comparison false, not an error;
- nothing compares with null;
- if the left side is no column, both sides are compared as text constants.

In join criteria both sides are columns, of the left and the right dataset, of
equal types; there two nulls match under every operator.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..dataset import Dataset
from ..errors import TableError

_SIDE = r'(?:"(?:[^"\\]|\\.)*"|[^\s()<>=!"]+)'
_PART = re.compile(rf"\s*(?:(?P<left>{_SIDE})\s*(?P<op>!=|>=|<=|=|>|<)\s*(?P<right>{_SIDE})|(?P<word>(?i:and|or)\b)|(?P<mark>[()]))\s*")
_OPERATORS = {"=": operator.eq, "!=": operator.ne, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}
_INTEGER = re.compile(r"[+-]?\d+")
_TIME = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2}) (\d{1,2}):(\d{1,2}):(\d{1,2})(?:\.(\d{1,9}))?")


def _text(side: str) -> str:
    return re.sub(r"\\(.)", r"\1", side[1:-1], flags=re.S) if side.startswith('"') else side


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def typed_literal(text: str, kind: T.DataType) -> str | None:
    """The SQL literal of a text for a column type; None where it does not fit."""
    if isinstance(kind, T.StringType):
        return _quoted(text)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        bits = 31 if isinstance(kind, T.IntegerType) else 63
        if _INTEGER.fullmatch(text) and -(1 << bits) <= int(text) < 1 << bits:
            return f"CAST({int(text)} AS {kind.simpleString()})"
        return None
    if isinstance(kind, T.DoubleType):
        try:
            return f"CAST({_quoted(repr(float(text)))} AS DOUBLE)" if text == text.strip() and "_" not in text else None
        except ValueError:
            return None
    if isinstance(kind, T.BooleanType):
        return str(text.lower() == "true").upper()
    if found := _TIME.fullmatch(text):
        *parts, fraction = found.groups()
        try:
            at = datetime(*map(int, parts), int((fraction or "0")[:6].ljust(6, "0")))
        except ValueError:
            return None
        return f"TIMESTAMP{'_NTZ' if isinstance(kind, T.TimestampNTZType) else ''} '{at.isoformat(sep=' ')}'"
    return None


def _expression(text: str, leaf: Callable[[str, str, str], str]) -> Column | None:
    """The expression, with leaf giving each comparison's SQL; None if empty."""
    at, parts, shape = 0, [], ""
    while at < len(text.rstrip()):
        found = _PART.match(text, at)
        if found is None:
            raise TableError(217, text[at : at + 40])
        parts.append(f"({leaf(found['left'], found['op'], found['right'])})" if found["op"] else found["word"] or found["mark"])
        shape += "c" if found["op"] else "&" if found["word"] else found["mark"]
        at = found.end()
    if not shape.strip("()"):
        return None
    # Spark parses an expression when it is used; its shape is checked here
    before = ""
    while shape != before:
        before, shape = shape, re.sub(r"\(c\)|c&c", "c", shape)
    if shape != "c":
        raise TableError(217, text)
    return F.expr(" ".join(parts))


def criteria_filter(data: Dataset, text: str | None) -> Column | None:
    """The filter of a dataset's rows; None where all rows match."""

    def leaf(left: str, op: str, right: str) -> str:
        name = _text(left)
        if left.startswith('"') or not data.has(name):
            return str(_OPERATORS[op](name, _text(right))).upper()
        literal = typed_literal(_text(right), data.type_of(name))
        return "FALSE" if literal is None else f"{_name(data.column(name))} {op} {literal}"

    return _expression(text or "", leaf)


def join_condition(left: Dataset, right: Dataset, text: str | None, prefixes: tuple[str, str], equal: list[tuple[str, str]] | None = None) -> Column | None:
    """The join condition over prefixed columns; None for a cross join. Columns of
    the pairs in equal are known to be equal."""

    def leaf(a: str, op: str, b: str) -> str:
        x, y = left.column(_text(a)), right.column(_text(b))
        if left.type_of(x) != right.type_of(y):
            raise TableError(254, f"{x}, {y}")
        if op == "=" and (x, y) in (equal or []):
            return "TRUE"
        x, y = _name(prefixes[0] + x), _name(prefixes[1] + y)
        return f"{x} <=> {y}" if op == "=" else f"{x} {op} {y} OR ({x} IS NULL AND {y} IS NULL)"

    return _expression(text or "", leaf)


def equal_columns(left: Dataset, right: Dataset, text: str | None) -> list[tuple[str, str]]:
    """The pairs of columns that valid join criteria require to be equal: those of
    comparisons that are alternatives to nothing."""
    groups: list[tuple[list[tuple[str, str]], list[bool]]] = [([], [])]
    for found in _PART.finditer(text or ""):
        if found["op"] == "=":
            groups[-1][0].append((left.column(_text(found["left"])), right.column(_text(found["right"]))))
        elif found["word"]:
            groups[-1][1].append(found["word"].lower() == "or")
        elif found["mark"] == "(":
            groups.append(([], []))
        elif found["mark"]:
            pairs, either = groups.pop()
            groups[-1][0].extend([] if any(either) else pairs)
    pairs, either = groups[0]
    return [] if any(either) else pairs
