"""The three ways in which numbers are read from text, and how they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def decode_currencies(text: Column) -> Column:
    for pattern, sign in ((r"(?i)&#163;|&pound;", "£"), (r"(?i)&#36;|&dollar;", r"\$"), (r"(?i)&#8364;|&euro;", "€"), (r"(?i)&#8358;", "₦")):
        text = F.regexp_replace(text, pattern, sign)
    return text


def whole_number(text: Column) -> Column:
    """The number that a whole text stands for: an empty text is zero, hexadecimal counts, names of
    infinities and units do not."""
    t = F.trim(text)
    return (
        F.when(t == "", F.lit(0.0)).when(t.rlike(DECIMAL), t.try_cast("double"))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substr(t, F.lit(3)), 16, 10).try_cast("double"))
    )


def first_number(text: Column) -> Column:
    """The first number in a text, commas left out."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, ",", ""), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def to_number(text: Column) -> Column:
    """A whole text as a number once currency signs, commas and blanks are gone; empty input is null."""
    return F.when(text != "", whole_number(F.regexp_replace(decode_currencies(text), r"[£$€₦,\s]", "")))


def number_text(x: Column) -> Column:
    """Whole numbers without a point, others in their shortest form."""
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string"))


def append_unit(x: Column, unit: str = "") -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x) & (x != 0), F.concat(number_text(x), F.lit(f" {unit}" if unit else "")))


def positive_integer(value: object, fallback: int, most: int) -> int:
    """A driver-side option: the leading digits of a value, within 1 and ``most``."""
    import re

    m = re.match(r"\s*\+?(\d+)", str(value))
    return min(int(m[1]), most) if m and int(m[1]) > 0 else fallback
