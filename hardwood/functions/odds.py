"""Odds and probability columns. Null odds give null unless a default is asked for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied(odds: Column, null_as: float | None = None, zero_as: float | None = None) -> Column:
    """American odds to the probability they imply."""
    o = odds.cast("double")
    p = F.when(o > 0, 100.0 / (o + 100.0)).when(o < 0, -o / (100.0 - o)).when(o == 0, F.lit(zero_as).cast("double"))
    return p if null_as is None else F.coalesce(p, F.lit(float(null_as)))


def decimal_odds(odds: Column, null_as: float = 1.0) -> Column:
    o = odds.cast("double")
    return F.when(o > 0, 1.0 + o / 100.0).when(o < 0, 1.0 - 100.0 / o).otherwise(F.lit(null_as))


def american(dec: Column) -> Column:
    """Decimal odds to American, halves to even; null at 1 or below."""
    return F.when(dec <= 1, None).when(dec < 2, F.bround(-100.0 / (dec - 1), 0)).otherwise(F.bround((dec - 1) * 100.0, 0)).cast("long")


def fair_american(p: Column) -> Column:
    """Odds without margin for a probability; null at 0 and 1."""
    return F.when((p <= 0) | (p >= 1), None).when(p >= 0.5, F.bround(-100.0 * p / (1 - p), 0)).otherwise(F.bround(100.0 * (1 - p) / p, 0)).cast("long")


def no_vig(over: Column, under: Column) -> Column:
    """The over probability with the margin taken out in proportion."""
    return F.try_divide(over, over + under)


def additive_no_vig(over: Column, under: Column) -> Column:
    """The over probability with half the margin taken from each side; one half where nothing is left."""
    cut = (over + under - 1) / 2
    a, b = F.greatest(over - cut, F.lit(0.0)), F.greatest(under - cut, F.lit(0.0))
    return F.when(over.isNull() | under.isNull(), None).when(a + b <= 0, 0.5).otherwise(a / F.when(a + b == 0, 1.0).otherwise(a + b))


def expected_value(p: Column, dec: Column) -> Column:
    """Expected profit of a unit stake."""
    return p * (dec - 1) - (1 - p)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cents(p: Column) -> Column:
    """A probability as an exchange price in whole cents, 1 to 99."""
    return F.bround(clip(p, 0.01, 0.99) * 100, 0).cast("long")
