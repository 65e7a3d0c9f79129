"""Cleaning of exported text columns. Every function maps STRING columns to a typed Column.

Nothing here raises on dirty input: what cannot be read becomes NULL (or the
documented default) and the jobs decide whether that rejects the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: texts that mean "missing" in an export -------------------
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_WORDS = ["TRUE", "1", "YES"]
FALSE_WORDS = ["FALSE", "0", "NO"]
FOOTER_KEY = r"^(PK:|Legend:)"
FESTIVAL_KEY = r"^FES\d+$"
# ----------------------------------------------------------------------------

# The JVM also reads "1d", "0x1p3" or "Infinity" as numbers; an export that says so is dirty.
# Texts a pattern refuses never reach a cast, where each would cost a caught exception.
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_ISO_TIME = r"^\s*\d{4}-\d{2}-\d{2}.*$"
_DAY_FIRST = r"^\s*\d{1,2}-\d{1,2}-\d{4}\s*$"
_DAY_FIRST_TIME = r"^\s*\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{2}\s*$"

# Missing markers are no numbers, flags or dates, so only text needs na_to_null.


def na_to_null(text: Column) -> Column:
    return F.when(~text.isin(NA_TOKENS), text)


def trimmed(text: Column) -> Column:
    return F.trim(na_to_null(text))


def _matching(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), F.trim(text))


def number(text: Column) -> Column:
    """DOUBLE, NULL where the text is no plain number."""
    return _matching(text, _NUMBER).try_cast("double")


def truncated_int(text: Column) -> Column:
    """INT with the fraction cut off."""
    return number(text).try_cast("int")


def whole_int(text: Column) -> Column:
    """INT, NULL where the number has a fraction."""
    value = number(text)
    return F.when(value % 1 == 0, value.try_cast("int"))


def int_or_zero(text: Column) -> Column:
    return F.coalesce(truncated_int(text), F.lit(0))


def strict_int(text: Column) -> Column:
    """INT from digits only: ``5.0`` is not one."""
    return _matching(text, _INTEGER).try_cast("int")


def rounded_int(text: Column) -> Column:
    """INT, rounded half-even."""
    return F.bround(number(text), 0).try_cast("int")


def _exact(text: Column) -> Column:
    return _matching(text, _NUMBER).try_cast("decimal(38,18)")


def money(text: Column) -> Column:
    """DECIMAL(18,2) rounded half-even, 0.00 where missing, NULL where malformed."""
    missing = text.isNull() | text.isin(NA_TOKENS) | (F.trim(text) == "")
    amount = F.bround(_exact(text), 2).try_cast("decimal(18,2)")
    return F.when(missing, F.lit(0).cast("decimal(18,2)")).otherwise(amount)


def price(text: Column) -> Column:
    """DECIMAL(18,2), NULL where missing or malformed."""
    return F.round(_exact(text), 2).try_cast("decimal(18,2)")


def flag(text: Column) -> Column:
    """TRUE/1/YES in any case; anything else, missing included, is false."""
    return F.coalesce(F.upper(F.trim(text)).isin(TRUE_WORDS), F.lit(False))


def true_false_or_null(text: Column) -> Column:
    word = F.upper(F.trim(text))
    return F.when(word == "TRUE", True).when(word == "FALSE", False)


def flag_or_null(text: Column) -> Column:
    word = F.upper(F.trim(text))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def iso_timestamp(text: Column) -> Column:
    return _matching(text, _ISO_TIME).try_cast("timestamp_ntz")


def iso_date(text: Column) -> Column:
    return iso_timestamp(text).cast("date")


def day_first_date(text: Column) -> Column:
    """``dd-MM-yyyy``."""
    return F.try_to_timestamp(_matching(text, _DAY_FIRST), F.lit("d-M-yyyy")).cast("date")


def day_first_timestamp(text: Column) -> Column:
    """``dd-MM-yyyy HH:mm``."""
    return F.try_to_timestamp(_matching(text, _DAY_FIRST_TIME), F.lit("d-M-yyyy H:mm")).cast("timestamp_ntz")


def barcode(text: Column) -> Column:
    """Digits of a code a spreadsheet turned into ``6.94802E+12``."""
    return F.substring_index(number(text).try_cast("decimal(38,6)").cast("string"), ".", 1)


def phone(text: Column) -> Column:
    return F.regexp_replace(trimmed(text), r"\.0$", "")


def list_items(text: Column) -> Column:
    """Comma list -> array of trimmed, non-blank items."""
    return F.filter(F.transform(F.split(na_to_null(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def paired(first: Column, second: Column) -> Column:
    """Array of pairs, as long as the shorter list (arrays_zip alone pads with NULL)."""
    shorter = F.least(F.array_size(first), F.array_size(second))
    return F.slice(F.arrays_zip(first.alias("left"), second.alias("right")), F.lit(1), shorter)
