"""The rounding rules the reports mix, each as a Column.

``round_half_up``    SQL NUMERIC rounding, half away from zero.
``round_half_even``  half-even on the exact binary value of a double, as Python's ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# Wide enough to absorb the last-bit noise of double division before a tie is judged.
_SNAP = "decimal(38,10)"


def round_half_up(value: Column, digits: int) -> Column:
    return F.round(value.cast(_SNAP), digits).cast("double")


def round_half_even(value: Column, digits: int) -> Column:
    """NaN and infinities pass through."""
    number = value.cast("double")
    scaled = F.abs(number) * 10.0**digits
    # bround looks at a double's shortest decimal text, which is on the wrong side of some ties (2.675); format_number
    # looks at the exact binary value, but by way of text, so it only judges what is close to a tie or very large.
    near_tie = F.abs(scaled - F.floor(scaled).cast("double") - 0.5) < 1e-6
    finite = ~F.isnan(number) & (F.abs(number) < 1e15)
    exact = F.translate(F.format_number(number, digits), ",", "").cast("double")
    return F.when(~finite, number).when(scaled >= 1e9, exact).when(near_tie, exact).otherwise(F.bround(number, digits))


def average(total: Column, count: Column) -> Column:
    """Mean of an exact decimal or integer sum, NULL for an empty group."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def grouped_integer(value: Column) -> Column:
    """Thousands-separated whole number, half-even (``1,234``)."""
    return F.format_number(value, 0)


def quantity_text(value: Column) -> Column:
    """A quantity as message text: ``45.0``, and a plain ``0`` when nothing is needed."""
    return F.when(value == 0, F.lit("0")).otherwise(value.cast("decimal(38,1)").cast("string"))
