"""Rule dispatch: which normalisation applies to a (source type, target type) pair."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F, types as T

from evenkeel import fixed_values as fv
from evenkeel.functions import normalise as nz
from evenkeel.functions.binding import first_row, let, rows_literal

Render = Callable[[Column, T.DataType | None], Column]


@dataclass(frozen=True)
class Rule:
    """``pairs`` are (source prefix, target prefix); ``*`` matches any type.

    A rule renders with a function of (column, data type) or with a ``{col}`` template.
    """

    name: str
    pairs: tuple[tuple[str, str], ...]
    render: Render | None = field(default=None, compare=False)
    template: str | None = None

    def apply(self, column_name: str, dtype: T.DataType | None = None) -> Column:
        quoted = "`" + column_name.replace("`", "``") + "`"
        if self.template is not None:
            return F.expr(self.template.format(col=quoted))
        return self.render(F.col(quoted), dtype)

    def apply_to_field(
        self, struct_name: str, field_name: str, dtype: T.DataType | None = None
    ) -> Column:
        """The rule on a field of a struct column."""
        path = ".".join("`" + n.replace("`", "``") + "`" for n in (struct_name, field_name))
        if self.template is not None:
            return F.expr(self.template.format(col=path))
        return self.render(F.col(path), dtype)


BY_NAME, NAME_KINDS = "by_name", ("json", "hstore")
_RENDER: dict[str, Render] = {
    "boolean": lambda c, t: nz.boolean(c),
    "numeric": lambda c, t: nz.numeric(c),  # other scales: decimal_rule
    "timestamp_tz": lambda c, t: nz.timestamp_tz(c),
    "timestamp_ntz": lambda c, t: nz.timestamp_ntz(c),
    "date": lambda c, t: nz.date(c),
    "uuid": lambda c, t: nz.uuid(c),
    "integer": nz.integer,
    "json": nz.json,
    "bytea": lambda c, t: nz.binary(c),
    "hstore": nz.hstore,
    "null_placeholder": lambda c, t: nz.plain(c),
    "text": lambda c, t: nz.text(c),
}


def normal_type(type_name: Column) -> Column:
    """Type text as rule prefixes expect it: no size, zone words folded, upper case."""
    c = F.regexp_replace(type_name, r"\([^)]*\)", "")
    c = F.regexp_replace(c, r"(?i)\s+without\s+time\s+zone", "_NTZ")
    c = F.regexp_replace(c, r"(?i)\s+with\s+time\s+zone", "_TZ")
    return F.coalesce(F.upper(F.trim(c)), F.lit(""))


class RuleBook:
    """Ordered rules; the first rule with a matching pair wins."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = rules if rules is not None else [
            Rule(name, tuple(pairs), _RENDER[name]) for name, pairs in fv.RULE_TRIGGERS.items()
        ]

    def register(
        self, name: str, pairs: list[tuple[str, str]], render: Render, before: str = "text"
    ) -> "RuleBook":
        """A new rule book with one more rule, ahead of the rule called ``before``."""
        return self._insert(Rule(name, tuple(pairs), render), before)

    def _insert(self, rule: Rule, before: str) -> "RuleBook":
        at = next((i for i, r in enumerate(self.rules) if r.name == before), len(self.rules))
        return RuleBook([*self.rules[:at], rule, *self.rules[at:]])

    def register_template(
        self, name: str, pairs: list[tuple[str, str]], template: str, before: str = "text"
    ) -> "RuleBook":
        """Rule from a ``{col}`` expression; a rule of the same name is replaced."""
        check_template(template)
        kept = RuleBook([r for r in self.rules if r.name.upper() != name.upper()])
        return kept._insert(Rule(name, tuple(pairs), template=template), before)

    def named(self, name: str) -> Rule:
        """A rule by name; ``numeric:4`` is the numeric rule with four decimal places,
        ``by_name:json`` the canonical text that such a column name asks for."""
        base, _, places = name.partition(":")
        if base == BY_NAME:
            return name_rule(places)
        rule = next(r for r in self.rules if r.name == base)
        if not places:
            return rule
        if base != "numeric":
            raise ValueError(f"rule {base!r} has no decimal places")
        return decimal_rule(int(places), rule.pairs)

    def assign(self, source_type: Column, target_type: Column) -> Column:
        """Rule name per row of a type-pair DataFrame.  One projection, no join."""
        # every text starts with the empty prefix, which is what ``*`` means
        triggers = rows_literal(
            ["s", "t", "rule"],
            [
                (*("" if p == "*" else p.upper() for p in pair), rule.name)
                for rule in self.rules
                for pair in rule.pairs
            ],
        )
        pair = F.struct(
            normal_type(source_type).alias("s"), normal_type(target_type).alias("t")
        )
        rule = let(
            pair,
            lambda p: first_row(
                triggers, lambda x: p["s"].startswith(x["s"]) & p["t"].startswith(x["t"])
            )["rule"],
        )
        return F.coalesce(rule, F.lit("text"))


def name_kind(column_name: str) -> str | None:
    """What the name of a text column says about its contents."""
    lowered = column_name.lower()
    return next((kind for kind in NAME_KINDS if kind in lowered), None)


def name_rule(kind: str) -> Rule:
    """Canonical text by column name: sorted JSON, or ``"k"=>"v"`` pairs as such; else as it is."""
    if kind not in NAME_KINDS:
        raise ValueError(f"{BY_NAME} takes one of {NAME_KINDS}, not {kind!r}")
    return Rule(f"{BY_NAME}:{kind}", (), lambda c, t: nz.by_column_name(c, kind))


def decimal_rule(places: int, pairs: tuple[tuple[str, str], ...] = ()) -> Rule:
    """The numeric rule with its own number of decimal places."""
    if not 0 <= places <= 38:
        raise ValueError(f"decimal places must be 0 to 38, not {places}")
    return Rule(f"numeric:{places}", pairs, lambda c, t: nz.numeric(c, places))


def check_template(template: str) -> None:
    """Reject anything beyond one read-only expression."""
    for mark in fv.BANNED_TEMPLATE_MARKS:
        if mark in template:
            raise ValueError(f"expression template may not contain {mark!r}")
    found = re.search(r"(?i)\b(?:" + "|".join(fv.BANNED_TEMPLATE_WORDS) + r")\b", template)
    if found:
        raise ValueError(f"expression template may not contain {found.group(0).upper()!r}")


def native_rule(dtype: T.DataType) -> str:
    """Rule name for a Spark type, for tables whose schema is read directly."""
    by_class = [
        (T.BooleanType, "boolean"),
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
        ((T.DecimalType, T.FloatType, T.DoubleType), "numeric"),
        (T.TimestampNTZType, "timestamp_ntz"),
        (T.TimestampType, "timestamp_tz"),
        (T.DateType, "date"),
        (T.BinaryType, "bytea"),
        (T.MapType, "hstore"),
        ((T.StructType, T.ArrayType, T.VariantType), "json"),
    ]
    return next((name for cls, name in by_class if isinstance(dtype, cls)), "text")
