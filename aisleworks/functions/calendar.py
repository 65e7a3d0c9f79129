"""Calendar columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SEASON_CODES = {"Winter": 1, "Summer": 2, "Monsoon": 3, "Autumn": 4}
DAY_CODES = {
    "Monday": 1, "Tuesday": 2, "Wednesday": 3, "Thursday": 4,
    "Friday": 5, "Saturday": 6, "Sunday": 7,
}
# ----------------------------------------------------------------------------


def as_date(as_of: dt.date | str | Column | None) -> Column:
    """An explicit reference day; today only when the caller names none."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def coded(value: Column, codes: dict[str, int]) -> Column:
    """Code of a label, 0 for an unknown or missing one."""
    lookup = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, value), F.lit(0))


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def season_code_of_month(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), 1)
        .when(month.between(3, 5), 2)
        .when(month.between(6, 9), 3)
        .otherwise(4)
    )
