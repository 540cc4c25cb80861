"""Small helpers for building expressions over fixed values."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Long ``when`` chains repeat their operands; without a binding every branch would carry the
    whole operand expression and the generated code would outgrow its limit.
    """
    return F.transform(F.array(value), body).getItem(0)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def rows_literal(names: Sequence[str], rows: Iterable[Sequence]) -> Column:
    """A constant array of structs, in the given order."""
    structs = (
        "named_struct(" + ", ".join(f"'{n}', {_sql(v)}" for n, v in zip(names, row)) + ")"
        for row in rows
    )
    return F.expr(f"array({', '.join(structs)})")


def map_literal(entries: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in entries.items()) + ")")


def first_row(rows: Column, matches: Callable[[Column], Column]) -> Column:
    """First struct of a constant array that matches, or NULL."""
    return F.get(F.filter(rows, matches), F.lit(0))


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    return c.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")


def ends_with_any(c: Column, suffixes: Sequence[str]) -> Column:
    return c.rlike("(?:" + "|".join(map(re.escape, suffixes)) + ")$")


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    return c.rlike("|".join(map(re.escape, phrases)))


def matches_any(c: Column, patterns: Sequence[str], at_start: bool = False) -> Column:
    """Regular expressions tried in one pass; ``at_start`` anchors them and ignores case."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return c.rlike(f"(?i)^(?:{joined})" if at_start else joined)


def filled(template: str, **values: Column) -> Column:
    """A text with ``{name}`` replaced by columns; NULL where one of them is."""
    parts = re.split(r"\{(\w+)\}", template)
    cells = [values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p]
    return F.concat(*cells)
