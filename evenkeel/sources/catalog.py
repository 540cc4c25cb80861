"""Column catalogs: one row per column of every table on a side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from evenkeel import fixed_values as fv
from evenkeel.functions.binding import map_literal
from evenkeel.schema import schema

CATALOG_SCHEMA = schema(
    "side string, table string, ordinal int, name string, type string, nullable boolean, "
    "precision int, scale int, is_key boolean, key_ordinal int"
)


def column_catalog(
    spark: SparkSession,
    tables: dict[str, DataFrame],
    side: str,
    keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Catalog rows from DataFrame schemas.  Schemas only; no table data is read."""
    return schema_catalog(spark, {t: f.schema for t, f in tables.items()}, side, keys)


def schema_catalog(
    spark: SparkSession,
    tables: dict[str, T.StructType],
    side: str,
    keys: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Catalog rows from schemas."""
    keys = {t: [k.lower() for k in ks] for t, ks in (keys or {}).items()}
    rows = []
    for table, found in tables.items():
        for i, f in enumerate(found.fields, start=1):
            decimal = isinstance(f.dataType, T.DecimalType)
            table_keys = keys.get(table, [])
            is_key = f.name.lower() in table_keys
            rows.append(
                (
                    side, table, i, f.name, f.dataType.simpleString(), f.nullable,
                    f.dataType.precision if decimal else None,
                    f.dataType.scale if decimal else None,
                    is_key, table_keys.index(f.name.lower()) + 1 if is_key else None,
                )
            )
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def warehouse_catalog(
    spark: SparkSession, database: str, side: str, at_once: int = 16,
    known: dict[tuple[str, str], T.StructType] | None = None,
) -> DataFrame:
    """Catalog of every table of a database known to the session catalog.

    Each schema is one call to the metastore; ``at_once`` of them run at a time.  ``known`` keeps
    schemas between calls: pass the same dict again, and only tables it lacks are asked for
    (:func:`forget` drops those that have changed).
    """
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    known = {} if known is None else known
    left = [n for n in names if (database, n) not in known]

    def read(name: str) -> tuple[str, T.StructType]:
        return name, spark.table(f"`{database}`.`{name}`").schema

    with ThreadPoolExecutor(max_workers=at_once) as workers:
        known.update(((database, n), found) for n, found in workers.map(read, left))
    return schema_catalog(spark, {n: known[database, n] for n in names}, side)


def forget(known: dict[tuple[str, str], T.StructType], database: str, *tables: str) -> None:
    """Drop what is known of some tables of a database, or of all of them."""
    for key in [k for k in known if k[0] == database and (not tables or k[1] in tables)]:
        del known[key]


def canonical_type(native_type: Column, system: str) -> Column:
    """Native type name of a system as the canonical type name rules are written for."""
    known, raw = {
        "sqlserver": (fv.SQLSERVER_TYPES, F.lower(native_type)),
        "athena": (
            fv.ATHENA_TYPES,
            F.regexp_replace(F.lower(F.trim(native_type)), r"\s*\(.*\)$", ""),
        ),
        "postgresql": ({}, native_type),
    }[system]
    if not known:
        return raw
    return F.coalesce(F.try_element_at(map_literal(known), raw), raw)
