"""Rounding of shares and scores to even, on the exact binary value.

Spark rounds the shortest decimal text half up; reports of shares and scores round an exact
tie to the even digit (0.625 -> 0.62) and everything else by the stored binary value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evenkeel.functions.binding import let

#: scaling a fraction by a power of two is exact and stays within 64 bits
_SCALE = 2**62


def round_even(c: Column, digits: int) -> Column:
    """``c`` in [0, 100] as a decimal with ``digits`` (1 or more) places."""
    whole = F.lit(_SCALE).cast("decimal(20,0)")
    value = c.cast("double")
    fraction = (value - F.floor(value)) * F.lit(float(_SCALE))
    scaled = fraction.cast("long").cast("decimal(20,0)")

    def rounded(parts: Column) -> Column:
        twice = parts["rest"] * F.lit(2)
        up = (twice > whole) | ((twice == whole) & (parts["units"] % 2 == 1))
        units = parts["whole"] + parts["units"] + F.when(up, 1).otherwise(0)
        return (units / F.lit(10**digits)).cast(f"decimal(12,{digits})")

    total = scaled * F.lit(10**digits)
    rest = total % whole
    units = ((total - rest) / whole).cast("long")
    before = F.floor(value) * F.lit(10**digits)
    return let(
        F.struct(before.alias("whole"), units.alias("units"), rest.alias("rest")), rounded
    )
