"""Row presence, value differences and whole-table equality.

All of it rests on the *ledger*: both sides are tagged, put under each other and grouped by
key.  Each side is shuffled once, and a key that is repeated many times (NULL keys, a
default key) collapses to one row per map task before the shuffle.  A join of the two sides
would multiply the copies of such a key instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from evenkeel.fixed_values import NULL_TOKEN
from evenkeel.functions.normalise import with_null_token
from evenkeel.operators.projection import ColumnPair, common_rule, quoted
from evenkeel.plans.rules import RuleBook

MISSING_IN_TARGET = "MISSING_IN_TARGET"
MISSING_IN_SOURCE = "MISSING_IN_SOURCE"
DUPLICATE_KEY = "DUPLICATE_KEY"
VALUE_MISMATCH = "VALUE_MISMATCH"


def ledger(
    source: DataFrame,
    target: DataFrame,
    pairs: Sequence[ColumnPair],
    keys: Sequence[str],
    book: RuleBook | None = None,
    strict_nulls: bool = False,
) -> DataFrame:
    """One row per distinct key: copies on each side and the values that may differ.

    Columns: the keys as text, ``source_rows``, ``target_rows`` and the structs
    ``source_values`` and ``target_values`` of normalised text.  The structs are set where the
    key occurs once per side and the stored values are not the same already; a value is
    rendered only there, and columns of one type travel through the shuffle as they are stored.
    ``strict_nulls`` keeps NULL apart from text that happens to equal the NULL token.

    Two tables that are bucketed alike by whole-number keys of one type
    (:func:`evenkeel.sources.layout.co_located`) are compared where they lie, without a shuffle.
    """
    book = book or RuleBook()
    wanted = {k.upper() for k in keys}
    key_pairs = [p for k in keys for p in pairs if p.source.upper() == k.upper()]
    if len(key_pairs) != len(wanted):
        raise KeyError(f"keys {list(keys)} are not all among the paired columns")
    value_pairs = [p for p in pairs if p.source.upper() not in wanted]
    token = None if strict_nulls else NULL_TOKEN
    s_types = {f.name: f.dataType for f in source.schema.fields}
    t_types = {f.name: f.dataType for f in target.schema.fields}
    stored = {
        p.source for p in value_pairs
        if s_types[p.source] == t_types[p.target] and _orderable(s_types[p.source])
    }

    def text(p: ColumnPair, side: str) -> Column:
        name, types = (p.source, s_types) if side == "source" else (p.target, t_types)
        return with_null_token(book.named(p.rule).apply(name, types[name]), token)

    def key(p: ColumnPair, side: str) -> Column:
        if _whole_number(p, s_types[p.source], t_types[p.target]):
            name = quoted(p.source if side == "source" else p.target)
            # as it is stored, a declared layout by the key spares the shuffle
            return name if s_types[p.source] == t_types[p.target] else name.cast("long")
        return text(p, side)

    def value(p: ColumnPair, side: str) -> Column:
        if p.source in stored:
            return quoted(p.source if side == "source" else p.target)
        return text(p, side)

    def tagged(frame: DataFrame, side: str) -> DataFrame:
        return frame.select(
            *[key(p, side).alias(k) for p, k in zip(key_pairs, keys)],
            F.lit(side == "source").alias("is_source"),
            F.struct(*[value(p, side).alias(p.source) for p in value_pairs]).alias("v")
            if value_pairs else F.lit(None).cast("string").alias("v"),
        )

    mine = F.col("is_source")
    grouped = (
        tagged(source, "source")
        .unionByName(tagged(target, "target"))
        .groupBy(*[quoted(k) for k in keys])
        .agg(
            F.sum(F.when(mine, 1).otherwise(0)).alias("source_rows"),
            F.sum(F.when(mine, 0).otherwise(1)).alias("target_rows"),
            F.max(F.when(mine, F.col("v"))).alias("s"),
            F.max(F.when(~mine, F.col("v"))).alias("t"),
        )
    )

    def shown(side: str) -> Column:
        fields = []
        for p in value_pairs:
            if p.source in stored:
                rendered = book.named(p.rule).apply_to_field(
                    side, p.source, s_types[p.source]
                )
                fields.append(with_null_token(rendered, token).alias(p.source))
            else:
                fields.append(F.col(side).getField(p.source).alias(p.source))
        return F.when(_comparable() & ~F.col("s").eqNullSafe(F.col("t")), F.struct(*fields))

    empty = F.lit(None).cast("string")
    return grouped.select(
        *[with_null_token(quoted(k), token).alias(k) for k in keys],
        "source_rows",
        "target_rows",
        (shown("s") if value_pairs else empty).alias("source_values"),
        (shown("t") if value_pairs else empty).alias("target_values"),
    )


def _orderable(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.AtomicType) and not isinstance(dtype, T.VariantType)


def _whole_number(p: ColumnPair, *types: T.DataType) -> bool:
    """Integers of any width on both sides group as numbers; their text is the same."""
    return p.rule == "integer" and all(isinstance(t, T.IntegralType) for t in types)


def _comparable() -> Column:
    return (F.col("source_rows") == 1) & (F.col("target_rows") == 1)


def _differs() -> Column:
    return _comparable() & ~F.col("source_values").eqNullSafe(F.col("target_values"))


def _duplicated() -> Column:
    return (F.col("source_rows") > 1) | (F.col("target_rows") > 1)


def row_diff(book: DataFrame, keys: Sequence[str], values: bool = True) -> DataFrame:
    """Keys that are missing, repeated or differ, with a status and an explanation.

    Presence is decided on distinct keys; a repeated key is reported as such, also when it is
    missing on the other side.  ``values=False`` looks at presence only and then shuffles
    nothing but keys and counts.
    """
    shown = F.concat_ws("|", *[quoted(k) for k in keys])

    def status(name: str, text: Column) -> Column:
        return F.struct(F.lit(name).alias("row_status"), text.alias("details"))

    found = [
        F.when(
            F.col("target_rows") == 0,
            status(
                MISSING_IN_TARGET,
                F.concat(F.lit("Row "), shown, F.lit(" exists in source but not in target")),
            ),
        ).when(
            F.col("source_rows") == 0,
            status(
                MISSING_IN_SOURCE,
                F.concat(F.lit("Row "), shown, F.lit(" exists in target but not in source")),
            ),
        ),
        F.when(
            _duplicated(),
            status(
                DUPLICATE_KEY,
                F.concat(
                    F.lit("Row "), shown, F.lit(" occurs "),
                    F.col("source_rows").cast("string"), F.lit(" time(s) in source and "),
                    F.col("target_rows").cast("string"), F.lit(" in target"),
                ),
            ),
        ),
    ]
    if values:
        found.append(
            F.when(
                _differs(),
                status(VALUE_MISMATCH, F.concat(F.lit("Row "), shown, F.lit(" has other values"))),
            )
        )
    problem = (F.col("target_rows") == 0) | (F.col("source_rows") == 0) | _duplicated()
    if values:
        problem = problem | _differs()
    return book.filter(problem).select(
        *[quoted(k) for k in keys], "source_rows", "target_rows",
        F.inline(F.array_compact(F.array(*found))),
    )


def _value_names(book: DataFrame) -> list[str]:
    dtype = book.schema["source_values"].dataType
    return dtype.names if isinstance(dtype, T.StructType) else []


def _part(side: str, name: str) -> Column:
    return F.col(f"{side}_values").getField(name)


def cell_diff(book: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Differing cells of keys that occur once on both sides."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                _part("source", c).alias("source_value"),
                _part("target", c).alias("target_value"),
            )
            for c in _value_names(book)
        ]
    )
    return book.filter(_differs()).select(
        *[quoted(k) for k in keys],
        F.inline(
            F.filter(cells, lambda x: ~x["source_value"].eqNullSafe(x["target_value"]))
        ),
    )


def mismatches_per_column(book: DataFrame) -> DataFrame:
    """How many comparable keys differ in each column."""
    wide = book.filter(_differs()).agg(
        *[
            F.count_if(~_part("source", c).eqNullSafe(_part("target", c))).alias(c)
            for c in _value_names(book)
        ]
    )
    rows = [
        F.struct(F.lit(c).alias("column_name"), quoted(c).alias("mismatches"))
        for c in _value_names(book)
    ]
    return wide.select(F.inline(F.array(*rows)))


def wide_diff(book: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
              ) -> DataFrame:
    """Differing rows with ``<column>_self`` / ``<column>_other``, NULL where equal.

    Give the columns that differ (:func:`mismatches_per_column`) to leave out the others.
    """
    out = []
    for c in columns or _value_names(book):
        differs = ~_part("source", c).eqNullSafe(_part("target", c))
        out.append(F.when(differs, _part("source", c)).alias(f"{c}_self"))
        out.append(F.when(differs, _part("target", c)).alias(f"{c}_other"))
    return book.filter(_differs()).select(*[quoted(k) for k in keys], *out)


def diff_counts(book: DataFrame) -> DataFrame:
    """One row with the numbers a data summary reports, and the status."""
    return book.agg(
        F.coalesce(F.sum("source_rows"), F.lit(0)).alias("source_count"),
        F.coalesce(F.sum("target_rows"), F.lit(0)).alias("target_count"),
        F.count_if(F.col("source_rows") == 0).alias("missing_in_source"),
        F.count_if(F.col("target_rows") == 0).alias("missing_in_target"),
        F.count_if(_differs()).alias("value_mismatches"),
        F.count_if(_duplicated()).alias("duplicate_keys"),
    ).withColumn(
        "status",
        F.when(
            F.col("missing_in_source") + F.col("missing_in_target")
            + F.col("value_mismatches") + F.col("duplicate_keys") == 0,
            "PASS",
        ).otherwise("FAIL"),
    )


# --- keys only ---------------------------------------------------------------------------


def key_ledger(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    target_keys: Sequence[str] | None = None,
    raw: bool = False,
) -> DataFrame:
    """Copies of every distinct key on each side.  NULL keys form one group.

    Keys of different types meet in the rule that :func:`ledger` uses for such a pair, so both
    agree on what is missing; whole numbers on both sides are grouped as numbers.  ``raw``
    compares text as it is stored, as SQL does; otherwise it is trimmed.
    """
    theirs = list(target_keys or keys)
    book = RuleBook()
    s_types, t_types = ({f.name: f.dataType for f in x.schema.fields} for x in (source, target))

    def rendered(name: str, own: T.DataType, other: T.DataType, ordered: tuple) -> Column:
        if isinstance(own, T.IntegralType) and isinstance(other, T.IntegralType):
            return quoted(name) if own == other else quoted(name).cast("long")
        if raw and own == other and _orderable(own):
            return quoted(name)
        return book.named(common_rule(*ordered)).apply(name, own)

    def side(frame: DataFrame, names: Sequence[str], s: int, t: int) -> DataFrame:
        cells = []
        for k, mine, other in zip(keys, keys, theirs):
            a, b = s_types[_actual(source, mine)], t_types[_actual(target, other)]
            name = mine if s else other
            own, far = (a, b) if s else (b, a)
            cells.append(rendered(_actual(frame, name), own, far, (a, b)).alias(k))
        return frame.select(
            *cells,
            F.lit(s).cast("long").alias("s_n"),
            F.lit(t).cast("long").alias("t_n"),
        )

    return (
        side(source, keys, 1, 0)
        .unionByName(side(target, theirs, 0, 1))
        .groupBy(*[quoted(k) for k in keys])
        .agg(F.sum("s_n").alias("source_rows"), F.sum("t_n").alias("target_rows"))
        .select(*[quoted(k).cast("string").alias(k) for k in keys], "source_rows", "target_rows")
    )


def _actual(frame: DataFrame, name: str) -> str:
    return frame.select(quoted(name)).columns[0] if name in frame.columns else next(
        c for c in frame.columns if c.lower() == name.lower()
    )


def missing_rows(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    target_keys: Sequence[str] | None = None,
    nulls: str = "match",
) -> DataFrame:
    """Source keys that the target lacks, with their number of source rows.

    ``nulls``: ``match`` lets a NULL key equal a NULL key; ``not_exists`` lets a NULL key equal
    nothing; ``not_in`` is SQL ``NOT IN``: one NULL among the target keys empties the result.
    The SQL forms compare text as stored, without trimming.
    """
    both = key_ledger(source, target, keys, target_keys, raw=nulls != "match")
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | quoted(k).isNull()
    present = F.col("source_rows") > 0
    absent = F.col("target_rows") == 0
    if nulls == "not_exists":
        absent = absent | any_null
    elif nulls == "not_in":
        if len(keys) != 1:
            raise ValueError("not_in takes a single key")
        name = (target_keys or keys)[0]
        # a one-row scalar subquery: NOT IN itself would broadcast the whole target
        facts = target.agg(
            F.struct(
                F.count_if(quoted(name).isNull()).alias("nulls"), F.count(F.lit(1)).alias("all")
            )
        ).scalar()
        absent = (absent & (facts["nulls"] == 0) & ~any_null) | (facts["all"] == 0)
    elif nulls != "match":
        raise ValueError(f"unknown nulls mode {nulls!r}")
    return both.filter(present & absent).select(*[quoted(k) for k in keys], "source_rows")


def orphan_rows(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    target_keys: Sequence[str] | None = None,
    nulls: str = "match",
) -> DataFrame:
    """Target keys that the source lacks, with their number of target rows."""
    names = list(target_keys or keys)
    found = missing_rows(target, source, names, keys, nulls)
    return found.withColumnRenamed("source_rows", "target_rows")


def key_difference(
    source: DataFrame, target: DataFrame, keys: Sequence[str],
    target_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Distinct keys found on one side only."""
    both = key_ledger(source, target, keys, target_keys)
    return both.filter((F.col("source_rows") == 0) | (F.col("target_rows") == 0)).select(
        *[quoted(k) for k in keys],
        F.when(F.col("target_rows") == 0, MISSING_IN_TARGET)
        .otherwise(MISSING_IN_SOURCE)
        .alias("row_status"),
    )


def key_intersection(
    source: DataFrame, target: DataFrame, keys: Sequence[str],
    target_keys: Sequence[str] | None = None,
) -> DataFrame:
    """Distinct keys found on both sides."""
    both = key_ledger(source, target, keys, target_keys)
    return both.filter((F.col("source_rows") > 0) & (F.col("target_rows") > 0)).select(
        *[quoted(k) for k in keys]
    )


# --- whole tables -------------------------------------------------------------------------


def surplus_rows(
    source: DataFrame, target: DataFrame, pairs: Sequence[ColumnPair],
    book: RuleBook | None = None,
) -> DataFrame:
    """Row contents that occur more often on one side, as multisets; order never matters.

    One grouping by all columns serves both directions.  Columns of one type are grouped as
    stored first: rows that are the same on both sides cancel out there, and only the rest is
    rendered and grouped again by its text.  Repeated rows collapse before the shuffle.
    """
    book = book or RuleBook()
    s_types = {f.name: f.dataType for f in source.schema.fields}
    t_types = {f.name: f.dataType for f in target.schema.fields}
    stored = {
        p.alias for p in pairs
        if s_types[p.source] == t_types[p.target] and _orderable(s_types[p.source])
    }
    names = [p.alias for p in pairs]

    def side(frame: DataFrame, which: str, n: int) -> DataFrame:
        cells = []
        for p in pairs:
            name, types = (p.source, s_types) if which == "source" else (p.target, t_types)
            if p.alias in stored:
                cells.append(quoted(name).alias(p.alias))
            else:
                rendered = book.named(p.rule).apply(name, types[name])
                cells.append(with_null_token(rendered).alias(p.alias))
        return frame.select(*cells, F.lit(n).cast("long").alias("__n"))

    def balance(rows: DataFrame) -> DataFrame:
        return (
            rows.groupBy(*[quoted(n) for n in names])
            .agg(F.sum("__n").alias("__n"))
            .filter(F.col("__n") != 0)
        )

    rest = balance(side(source, "source", 1).unionByName(side(target, "target", -1)))
    if stored:
        texts = [
            with_null_token(book.named(p.rule).apply(p.alias, s_types[p.source])).alias(p.alias)
            if p.alias in stored else quoted(p.alias)
            for p in pairs
        ]
        rest = balance(rest.select(*texts, "__n"))
    return rest.select(
        *[quoted(n) for n in names],
        F.when(F.col("__n") > 0, "source").otherwise("target").alias("surplus_side"),
        F.abs("__n").alias("surplus_rows"),
    )


def same_rows(
    source: DataFrame, target: DataFrame, pairs: Sequence[ColumnPair],
    book: RuleBook | None = None,
) -> DataFrame:
    """PASS when both tables hold the same rows the same number of times."""
    return (
        surplus_rows(source, target, pairs, book)
        .agg(
            F.coalesce(
                F.sum(F.when(F.col("surplus_side") == "source", F.col("surplus_rows"))), F.lit(0)
            ).alias("source_surplus"),
            F.coalesce(
                F.sum(F.when(F.col("surplus_side") == "target", F.col("surplus_rows"))), F.lit(0)
            ).alias("target_surplus"),
        )
        .withColumn(
            "status",
            F.when(F.col("source_surplus") + F.col("target_surplus") == 0, "PASS").otherwise(
                "FAIL"
            ),
        )
    )
