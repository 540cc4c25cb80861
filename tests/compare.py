"""Run a registered query and its check side by side."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

from evenkeel.suite.fixtures import TABLES

FAMILIES = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int",
    "float": "float", "double": "float", "string": "text", "varchar": "text",
    "boolean": "bool", "date": "date", "timestamp_ntz": "time", "timestamp": "time",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize())
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(frame, con, sql, limit=3):
    """Empty when both sides agree on column names, type families and rows."""
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    kinds = {c[0]: FAMILIES.get(str(c[1]).lower(), str(c[1]).lower()) for c in found.description}
    theirs = found.fetchall()
    if sorted(names) != sorted(frame.columns):
        return [("columns", sorted(frame.columns), sorted(names))]
    mine = {f.name: FAMILIES.get(f.dataType.simpleString(), f.dataType.simpleString())
            for f in frame.schema.fields}
    if mine != kinds:
        return [("types", {k: (mine[k], kinds[k]) for k in mine if mine[k] != kinds[k]})]
    a = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    b = _rows(names, theirs)
    if a == b:
        return []
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return [("rows", len(a), len(b), only_a[:limit], only_b[:limit])]
