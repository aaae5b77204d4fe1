"""Rounding and ratios."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves whose products with small integers are exact.
_SPLIT = 134217729.0


def round_float(x: Column, places: int) -> Column:
    """Round a double on its exact binary value, ties to even.

    ``F.round`` works on the shortest decimal text of a double, so it takes
    2.675 for a tie although the stored value lies below it. Here the scaled
    value is compared with the tie exactly: only where the scaled double sits
    on a tie does the rounding error of the product decide the direction.
    """
    scale = float(10**places)
    scaled = x * F.lit(scale)
    shifted = x * F.lit(_SPLIT)
    high = shifted - (shifted - x)
    low = x - high
    error = (high * F.lit(scale) - scaled) + low * F.lit(scale)
    whole = F.floor(scaled)
    part = scaled - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 != 0))))
    return (whole + up.cast("int")) / F.lit(scale)


def guarded_ratio(part: Column, whole: Column, empty: Column) -> Column:
    """``part / whole`` or ``empty`` where ``whole`` is 0."""
    return F.when(whole == 0, empty).otherwise(part / F.nullif(whole, F.lit(0)))
