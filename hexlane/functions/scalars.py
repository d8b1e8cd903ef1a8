"""Scalar cleaning functions as Column expressions; none raises on bad input under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import LIVE_VENUES

WIDE, NARROW = "０１２３４５６７８９－＝　．：", "0123456789-= .:"


def narrow(text: Column) -> Column:
    """Full-width digits and signs to ASCII."""
    return F.translate(text, WIDE, NARROW)


def combo_normalize(text: Column) -> Column:
    """The first three of the digits 1-6 joined by '-', or ''."""
    digits = F.regexp_extract_all(narrow(F.coalesce(text, F.lit(""))), F.lit("[1-6]"), F.lit(0))
    return F.when(F.size(digits) >= 3, F.array_join(F.slice(digits, 1, 3), "-")).otherwise("")


def combo_lane(combo: Column, place: int) -> Column:
    """Lane at place 0, 1 or 2; 0 where the combo isn't of three numbers."""
    parts = F.split(combo, "-")
    return F.when(F.size(parts) == 3, F.coalesce(F.get(parts, F.lit(place)).try_cast("int"), F.lit(0))).otherwise(0)


def blank(text: Column) -> Column:
    return text.isNull() | F.trim(text).isin("", "-", "－", "None")


def finite(number: Column, default: float = 0.0) -> Column:
    """Null, NaN and infinities become the default."""
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(number)


def safe_double(text: Column, default: float = 0.0) -> Column:
    """Number in a cell: F. or L. before a decimal part, a bare leading point, a unit (CM before M) and commas are allowed."""
    t = F.upper(F.trim(narrow(text)))
    t = F.regexp_replace(F.regexp_replace(t, ",", ""), "(CM|M|℃)$", "")
    t = F.regexp_replace(F.regexp_replace(t, "^[FL]?\\.", "0."), "^[FL]", "")
    return finite(F.when(t.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?([E][+-]?[0-9]+)?$"), t.try_cast("double")), default)


def start_timing(text: Column) -> Column:
    """Start timing; a false start (F) is negative, unreadable is null."""
    t = F.trim(narrow(text))
    number = F.regexp_extract(t, r"([0-9]*\.[0-9]+)", 1)
    value = F.when(number != "", F.concat(F.lit("0"), number).try_cast("double"))
    return F.when(t.startswith("F"), -value).otherwise(value)


def zfill(text: Column, width: int) -> Column:
    """Left-pad with zeros, leaving longer text whole."""
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def dashed(date: Column) -> Column:
    return F.concat_ws("-", F.substring(date, 1, 4), F.substring(date, 5, 2), F.substring(date, 7, 2))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < 1e-12, F.lit(0.0)).otherwise(F.try_divide(a, b))


def venue_code(text: Column) -> Column:
    """Code of a live venue from its name or code, else 'default'."""
    out = None
    for code, name in LIVE_VENUES.items():
        hit = text.contains(name) | (zfill(F.trim(text), 2) == code)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("default")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round_to(x: Column | str, digits: int) -> Column:
    """A double rounded as the SQL rounds it: the product with 10^digits to a whole number, halves away from zero, and divided again.

    F.round goes by the decimal text instead, which takes another side where a short decimal ends in a 5: 1.44366125 to 7 digits is
    1.4436613 there, but the product is 14436612.499999998.
    """
    unit = 10.0**digits
    return F.round((F.col(x) if isinstance(x, str) else x) * unit) / unit
