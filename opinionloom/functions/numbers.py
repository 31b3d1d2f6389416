"""Rounding and formatting of figures."""

from pyspark.sql import functions as F


def round_half_even(value, digits):
    """Scale, round to the even neighbour, scale back: what array libraries do for doubles."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def share(part, whole):
    """Percentage of part in whole; 0 when whole is 0."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
