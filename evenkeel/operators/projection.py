"""Header, column and row selection, and the normalised projection of a table pair."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel import fixed_values as fv
from evenkeel.functions import normalise as nz
from evenkeel.plans.rules import BY_NAME, RuleBook, name_kind, native_rule


def clean_headers(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[c.strip().lower() for c in frame.columns])


def find_column(frame: DataFrame, wanted: str) -> str:
    """Actual column for a name or for its ``_normalized`` alias, ignoring case."""
    by_upper = {c.upper(): c for c in reversed(frame.columns)}
    for candidate in (wanted, f"{wanted}_normalized"):
        if candidate.upper() in by_upper:
            return by_upper[candidate.upper()]
    raise KeyError(f"column {wanted!r} not found in {frame.columns}")


def excluded_names(saved: Iterable[str] = (), this_run: Iterable[str] = ()) -> list[str]:
    """Load-metadata names, saved exclusions and per-run names; first occurrence wins."""
    names = [*fv.LOAD_METADATA_COLUMNS, *saved, *this_run]
    return list(dict.fromkeys(n.strip().lower() for n in names))


def drop_excluded(frame: DataFrame, excluded: Iterable[str]) -> DataFrame:
    unwanted = {n.lower() for n in excluded}
    return frame.select(*[quoted(c) for c in frame.columns if c.lower() not in unwanted])


def active_rows(frame: DataFrame, column: str = fv.ACTIVE_COLUMN) -> DataFrame:
    """Rows whose active flag is TRUE, when the flag exists.  For the target side."""
    for c in frame.columns:
        if c.lower() == column.lower():
            return frame.filter(quoted(c) == F.lit(True))
    return frame


def load_window(
    frame: DataFrame, load_type: str, column: str | None = None, low=None, high=None
) -> DataFrame:
    """Inclusive window for ``incremental`` loads; other load types read everything.

    Bounds take the type of the column, so a wall-clock column is cut by wall-clock bounds
    whatever the session zone, and the filter stays on the bare column.
    """
    if load_type.strip().lower() != "incremental":
        return frame
    name = next(c for c in frame.columns if c.lower() == column.lower())
    dtype = frame.schema[name].dataType

    def bound(value) -> Column:
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(str(value)).cast(dtype)
        return F.lit(value)

    return frame.filter(quoted(name).between(bound(low), bound(high)))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class ColumnPair:
    """One compared column: its name on both sides and the rule that renders it."""

    source: str
    target: str
    rule: str

    @property
    def alias(self) -> str:
        return f"{self.source}_normalized"


def pair_columns(
    source: DataFrame,
    target: DataFrame,
    renamed: dict[str, str] | None = None,
    excluded: Iterable[str] = (),
    rules: dict[str, str] | None = None,
    decimal_places: dict[str, int] | None = None,
    by_contents: bool = False,
) -> list[ColumnPair]:
    """Pair the columns of two tables by configured name, name, then name key.

    The rule follows the wider of the two Spark types unless ``rules`` names one; decimals are
    compared to the larger declared scale (two places at least), with floats too, unless
    ``decimal_places`` says otherwise for a source column.  Two floats are compared to two places.
    A target column has one partner, unless ``renamed`` gives it more: names come before name keys,
    then the first column.  With ``by_contents``, text columns whose source name speaks of JSON or
    hstore are compared by their canonical contents.  :func:`uncompared_columns` lists what found no
    partner.
    """
    places = {k.upper(): v for k, v in (decimal_places or {}).items()}
    renamed = {k.upper(): v.upper() for k, v in (renamed or {}).items()}
    rules = {k.upper(): v for k, v in (rules or {}).items()}
    unwanted = {n.lower() for n in excluded}
    by_name = {f.name.upper(): f for f in target.schema.fields}
    by_key: dict[str, T.StructField] = {}
    for f in target.schema.fields:
        by_key.setdefault(_key(f.name), f)
    mine = [f for f in source.schema.fields if f.name.lower() not in unwanted]
    partners = {
        f.name: by_name.get(renamed.get(f.name.upper(), "")) or by_name.get(f.name.upper())
        for f in mine
    }
    taken = {other.name for other in partners.values() if other is not None}
    pairs = []
    for f in mine:
        upper = f.name.upper()
        other = partners[f.name]
        if other is None:
            other = by_key.get(_key(f.name))
            if other is not None and other.name in taken:
                continue
        if other is None or other.name.lower() in unwanted:
            continue
        taken.add(other.name)
        rule = rules.get(upper) or common_rule(f.dataType, other.dataType)
        if by_contents and rule == "text" and upper not in rules and name_kind(f.name):
            rule = f"{BY_NAME}:{name_kind(f.name)}"
        if upper in places and rule.partition(":")[0] == "numeric":
            rule = f"numeric:{places[upper]}"
        pairs.append(ColumnPair(f.name, other.name, rule))
    return pairs


def uncompared_columns(
    source: DataFrame,
    target: DataFrame,
    pairs: Iterable[ColumnPair],
    excluded: Iterable[str] = (),
) -> list[tuple[str, str, str]]:
    """(side, column, reason) of every column that no pair covers."""
    pairs = list(pairs)
    unwanted = {n.lower() for n in excluded}
    used = {"source": {p.source for p in pairs}, "target": {p.target for p in pairs}}
    other = {"source": "target", "target": "source"}
    by_key = {_key(p.target): p for p in reversed(pairs)}

    def reason(side: str, c: str) -> str:
        if c.lower() in unwanted:
            return "excluded"
        rival = by_key.get(_key(c)) if side == "source" else None
        if rival is not None:
            return f"its partner {rival.target} is compared with {rival.source}"
        return f"no partner in {other[side]}"

    return [
        (side, c, reason(side, c))
        for side, frame in (("source", source), ("target", target))
        for c in frame.columns
        if c not in used[side]
    ]


def _key(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


def common_rule(a: T.DataType, b: T.DataType) -> str:
    """Rule for two native types; types that render differently meet in the richer rule."""
    first, second = native_rule(a), native_rule(b)
    # a float has no declared scale: the decimal that it is compared with decides
    exact = all(isinstance(t, T.NumericType) for t in (a, b))
    scale = max(t.scale if isinstance(t, T.DecimalType) else 0 for t in (a, b))
    if exact and scale > fv.DECIMAL_PLACES:
        return f"numeric:{scale}"
    if first == second:
        return first
    for wide in ("boolean", "numeric", "timestamp_ntz", "date", "json", "hstore"):
        if wide in (first, second):
            return wide
    return "text"


def normalised(
    frame: DataFrame,
    pairs: list[ColumnPair],
    side: str,
    book: RuleBook | None = None,
    null_token: str | None = fv.NULL_TOKEN,
) -> DataFrame:
    """Text rendering of every paired column under one alias for both sides.

    ``side`` is ``source`` or ``target``.  Apply row filters first so that they stay on raw
    columns and reach the scan.
    """
    book = book or RuleBook()
    types = {f.name: f.dataType for f in frame.schema.fields}
    columns = []
    for pair in pairs:
        name = pair.source if side == "source" else pair.target
        rendered = book.named(pair.rule).apply(name, types[name])
        columns.append(nz.with_null_token(rendered, null_token).alias(pair.alias))
    return frame.select(*columns)


def ordered_export(frame: DataFrame, pairs: list[ColumnPair], keys: list[str], side: str
                   ) -> DataFrame:
    """Normalised rows in key order, for a user who wants to read them.

    Comparison never needs the order.
    """
    aliases = {p.source.upper(): p.alias for p in pairs}
    return normalised(frame, pairs, side).orderBy(*[aliases[k.upper()] for k in keys])

