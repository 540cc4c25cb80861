"""Name keys, similarity and scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evenkeel import fixed_values as fv
from evenkeel.functions.binding import filled, first_row, let, rows_literal
from evenkeel.functions.rounding import round_even

#: longest name whose bit vector fits a signed 64-bit integer without overflow
BIT_NAME_LENGTH = 61


def name_key(c: Column) -> Column:
    """Lower-case letters and digits only; empty for NULL."""
    return F.coalesce(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def same_name(a: Column, b: Column) -> Column:
    return name_key(a) == name_key(b)


def words(c: Column) -> Column:
    return F.split(F.lower(c), r"[_\s]+")


def has_word(c: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(words(c), F.lit(wanted))


def char_codes(key: Column) -> Column:
    """Characters of a name key as numbers: letters 1 to 26, digits 27 to 36."""
    chars = F.filter(F.split(key, ""), lambda ch: ch != F.lit(""))
    return F.transform(
        chars,
        lambda ch: F.when(ch >= "a", F.ascii(ch) - F.lit(96)).otherwise(F.ascii(ch) - F.lit(21)),
    )


def name_bits(key: Column) -> Column:
    """What one name key needs to be compared with many others.

    ``masks[c - 1]`` is the bit set of the positions of character ``c``, ``full`` the set of
    all positions.
    """
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def mask(codes: Column, code: Column) -> Column:
        here = F.transform(
            codes,
            lambda c, i: F.when(c == code, F.call_function("shiftleft", one, i)).otherwise(zero),
        )
        return F.aggregate(here, zero, lambda acc, bit: acc.bitwiseOR(bit))

    return F.struct(
        let(
            char_codes(key),
            lambda codes: F.transform(
                F.sequence(F.lit(1), F.lit(36)), lambda code: mask(codes, code)
            ),
        ).alias("masks"),
        (F.call_function("shiftleft", one, F.length(key)) - F.lit(1)).alias("full"),
    )


def _lcs_bits(length: Column, bits: Column, codes: Column) -> Column:
    """Longest common subsequence by the bit-vector recurrence of Hyyrö (2004)."""
    steps = F.transform(codes, lambda c: F.get(bits["masks"], c - 1))
    rest = F.aggregate(
        steps,
        bits["full"],
        lambda v, m: (v + v.bitwiseAND(m))
        .bitwiseOR(v.bitwiseAND(F.bitwise_not(m)))
        .bitwiseAND(bits["full"]),
    )
    return length - F.bit_count(rest)


def _lcs_table(a: Column, b: Column) -> Column:
    """Longest common subsequence row by row, for names beyond the bit-vector length."""
    a_chars = F.filter(F.split(a, ""), lambda ch: ch != F.lit(""))
    b_chars = F.filter(F.split(b, ""), lambda ch: ch != F.lit(""))
    start = F.transform(F.sequence(F.lit(0), F.size(b_chars)), lambda _: F.lit(0))

    def next_row(prev: Column, ch: Column) -> Column:
        return F.aggregate(
            b_chars,
            F.array(F.lit(0)),
            lambda row, bc: F.concat(
                row,
                F.array(
                    F.when(
                        bc == ch, F.element_at(prev, F.size(row)) + 1
                    ).otherwise(
                        F.greatest(
                            F.element_at(prev, F.size(row) + 1), F.element_at(row, -1)
                        )
                    )
                ),
            ),
        )

    return F.element_at(F.aggregate(a_chars, start, next_row), -1)


def similarity(
    a: Column, b: Column, a_bits: Column | None = None, b_codes: Column | None = None
) -> Column:
    """``2 * LCS / (len a + len b)`` of two name keys, in [0, 1]; 0 when either is empty.

    ``a_bits`` and ``b_codes`` may carry :func:`name_bits` of ``a`` and :func:`char_codes` of
    ``b`` when names meet many others.
    """
    short = _lcs_bits(
        F.length(a),
        name_bits(a) if a_bits is None else a_bits,
        char_codes(b) if b_codes is None else b_codes,
    )
    common = F.when(F.length(a) <= BIT_NAME_LENGTH, short).otherwise(_lcs_table(a, b))
    return (
        F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .otherwise(F.lit(2.0) * common / (F.length(a) + F.length(b)))
    )


def edit_similarity(a: Column, b: Column) -> Column:
    """Cheaper variant: ``1 - levenshtein / longer length``."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - F.levenshtein(a, b) / longest
    )


def within_one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) >= 0


def one_deletion_forms(c: Column) -> Column:
    """The text itself and every text with one character removed.

    Two texts within one edit share at least one form, so an equi-join on the forms finds
    every such pair.
    """
    return F.array_distinct(
        F.concat(
            F.array(c),
            F.transform(
                F.when(F.length(c) > 0, F.sequence(F.lit(1), F.length(c))).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)),
            ),
        )
    )


def score_band(
    score: Column, high: float = fv.HIGH_CONFIDENCE, review: float = fv.REVIEW_CONFIDENCE
) -> Column:
    return F.when(score >= high, "high").when(score >= review, "review").otherwise("below")


def position_proximity(a: Column, b: Column, total: Column) -> Column:
    gap = F.abs(a - b).cast("double") / F.greatest(total - 1, F.lit(1))
    return F.when(total <= 1, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap))


def base_type(c: Column) -> Column:
    """Upper-case type name without its size, as compatibility lookups use it."""
    return F.upper(F.trim(F.regexp_replace(c, r"\s*\([^)]*\)", "")))


def type_compatibility(source_type: Column, target_type: Column) -> Column:
    """Exact pair first, then the first prefix pair in list order, else neutral."""
    known = rows_literal(
        ["s", "t", "score"], [(a.upper(), b.upper(), v) for a, b, v in fv.TYPE_COMPATIBILITY]
    )

    def lookup(p: Column) -> Column:
        exact = first_row(known, lambda k: (p["s"] == k["s"]) & (p["t"] == k["t"]))
        prefix = first_row(
            known, lambda k: p["s"].startswith(k["s"]) & p["t"].startswith(k["t"])
        )
        return F.coalesce(exact, prefix)["score"]

    pair = F.struct(base_type(source_type).alias("s"), base_type(target_type).alias("t"))
    return F.coalesce(let(pair, lookup), F.lit(fv.UNKNOWN_COMPATIBILITY))


def confidence(name: Column, types: Column, position: Column, learned: Column) -> Column:
    total = (
        name * fv.WEIGHT_NAME
        + types * fv.WEIGHT_TYPE
        + position * fv.WEIGHT_POSITION
        + learned * fv.WEIGHT_LEARNED
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def confidence_reason(
    source_key: Column,
    target_key: Column,
    source_type: Column,
    target_type: Column,
    name: Column,
    types: Column,
    learned: Column,
) -> Column:
    """Explanation text made of name, type and learned-pair sentences."""
    values = {"source": source_key, "target": target_key, "score": round_even(name, 2)}
    name_part = (
        F.when(source_key == target_key, filled(fv.NAMES_IDENTICAL, **values))
        .when(name >= 0.90, filled(fv.NAMES_VERY_SIMILAR, **values))
        .when(name >= 0.75, filled(fv.NAMES_SIMILAR, **values))
        .otherwise(filled(fv.NAMES_UNLIKE, **values))
    )
    pair = filled("{source} → {target}", source=source_type, target=target_type)
    type_part = (
        F.when(types >= 0.95, filled(fv.TYPES_COMPATIBLE, pair=pair))
        .when(types >= 0.75, filled(fv.TYPES_MIGRATED, pair=pair))
        .otherwise(filled(fv.TYPES_UNKNOWN, pair=pair))
    )
    learned_part = F.when(learned >= 1.0, F.lit(fv.LEARNED_EXISTS))
    return F.concat(F.concat_ws(". ", name_part, type_part, learned_part), F.lit("."))
