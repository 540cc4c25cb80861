"""Value normalisation: every rule turns a column into comparable text.

A rule returns NULL for NULL; :func:`with_null_token` turns the result into the text that
is compared.  All rules are built-in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from evenkeel.fixed_values import DECIMAL_PLACES, NULL_TOKEN


def with_null_token(text: Column, null_token: str | None = NULL_TOKEN) -> Column:
    """Outermost wrapper of every rule; ``null_token=None`` keeps NULL as NULL."""
    text = text.cast("string")
    return text if null_token is None else F.coalesce(text, F.lit(null_token))


def boolean(c: Column, true_text: str = "1", false_text: str = "0") -> Column:
    """Booleans and 0/1 flags; anything else keeps its own text, so that it equals no flag and no
    NULL."""
    text = F.trim(c.cast("string"))
    raw = F.lower(text)
    return F.when(raw.isin("true", "1"), F.lit(true_text)).when(
        raw.isin("false", "0"), F.lit(false_text)
    ).otherwise(text)


def integer(c: Column, dtype: T.DataType | None = None) -> Column:
    """Integer text.  Integral values held in a float lose the ``.0``."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        digits = c.try_cast("decimal(38,0)")  # NULL for NaN, infinity and beyond 38 digits
        return F.when(digits.cast("double") == c.cast("double"), digits.cast("string")).otherwise(
            c.cast("string")
        )
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(c.cast("string"), r"\.0+$", "")
    return c.cast("string")


def numeric(c: Column, decimal_places: int = DECIMAL_PLACES) -> Column:
    """Half-up rounding to a fixed scale; non-numbers (NaN, text) keep their own text."""
    fixed = c.try_cast(f"decimal(38,{decimal_places})")  # the cast rounds half up
    return F.coalesce(fixed.cast("string"), F.trim(c.cast("string")))


def timestamp_ntz(c: Column) -> Column:
    """Wall-clock seconds; the fraction is cut, not rounded.  Independent of session zone."""
    text = F.substring_index(c.try_cast("timestamp_ntz").cast("string"), ".", 1)
    return F.coalesce(text, F.trim(c.cast("string")))


def timestamp_tz(c: Column) -> Column:
    """An instant shown as UTC wall-clock seconds.  Independent of session zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    # whole seconds as stored: micros divided as doubles lose whole micros after about 2255
    return F.timestamp_add("SECOND", F.unix_seconds(c.cast("timestamp")), epoch).cast("string")


def date(c: Column) -> Column:
    return F.coalesce(c.try_cast("date").cast("string"), F.trim(c.cast("string")))


def text(c: Column) -> Column:
    """Strips spaces only; tabs stay and the empty string stays distinct from NULL."""
    return F.trim(c.cast("string"))


def uuid(c: Column) -> Column:
    return F.upper(F.trim(c.cast("string")))


def json(c: Column, dtype: T.DataType | None = None) -> Column:
    """Compact JSON with sorted keys.  Text that does not parse stays as trimmed text."""
    if isinstance(dtype, T.MapType):
        return sorted_map(c)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.VariantType)):
        raw = F.to_json(c)
    else:
        raw = F.trim(c.cast("string"))
    return F.coalesce(F.to_json(F.try_parse_json(raw)), raw)


def binary(c: Column) -> Column:
    return F.lower(F.hex(c))


def sorted_map(c: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))


def hstore(c: Column, dtype: T.DataType | None = None) -> Column:
    if isinstance(dtype, T.MapType):
        return sorted_map(c)
    return F.trim(c.cast("string"))


def hstore_pairs(c: Column) -> Column:
    """``"k"=>"v"`` pairs as sorted JSON; the last duplicate wins; no pairs gives NULL."""
    # fixed value: the pair pattern
    pattern = r'"([^"]+)"\s*=>\s*"([^"]*)"'
    keys = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    # keep a pair unless its key comes again later: no dependence on session dedup policy
    last = F.filter(
        pairs,
        lambda pair, i: ~F.array_contains(
            F.slice(keys, i + F.lit(2), F.greatest(F.size(keys) - i - 1, F.lit(0))), pair["k"]
        ),
    )
    merged = F.map_from_arrays(
        F.transform(last, lambda p: p["k"]), F.transform(last, lambda p: p["v"])
    )
    return F.when(F.size(keys) > 0, F.to_json(F.try_parse_json(F.to_json(merged))))


def by_column_name(c: Column, name: str) -> Column:
    """Canonical text chosen from the column name: JSON, hstore or plain stripped text."""
    # all leading and trailing white space, as a string strip does
    stripped = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    lowered = name.lower()
    if "json" in lowered:
        return F.coalesce(F.to_json(F.try_parse_json(stripped)), stripped)
    if "hstore" in lowered:
        return F.when(
            stripped.startswith("{"),
            F.coalesce(F.to_json(F.try_parse_json(stripped)), stripped),
        ).otherwise(F.coalesce(hstore_pairs(stripped), stripped))
    return stripped


def xml(c: Column) -> Column:
    return F.trim(c.cast("string"))


def plain(c: Column) -> Column:
    return c.cast("string")
