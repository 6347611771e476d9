"""Numbers, units and three-valued attribute comparison as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, once, squeeze

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Spellings of units that mean the same.
UNIT_ALIASES = {
    "℃": "c", "°c": "c", "도씨": "c", "섭씨": "c", "degc": "c", "c": "c",
    "%": "pct", "%rh": "pct_rh", "rh%": "pct_rh",
    "v": "v", "볼트": "v",
    "ma": "ma", "a": "a",
    "mah": "mah", "ah": "ah",
}


def as_number(text: Column | str) -> Column:
    """A double from text with thousands commas, or null.  ``nan``, ``inf`` and underscores are not numbers."""
    return _number(_trimmed(text))


def _trimmed(text: Column | str) -> Column:
    return F.regexp_replace(F.replace(_col(text).cast("string"), F.lit(","), F.lit("")), r"(?U)^\s+|\s+$", "")


def _number(trimmed: Column) -> Column:
    return F.when(trimmed.rlike(_NUMBER), trimmed.try_cast("double"))


def is_numeric(text: Column | str) -> Column:
    return as_number(text).isNotNull()


def canonical_unit(unit: Column | str) -> Column:
    """The unit's common name; empty for none; null if it is not known."""
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(UNIT_ALIASES.items())))
    return once(squeeze(unit), lambda u: F.when(u == "", "").otherwise(F.try_element_at(known, u)))


def units_compatible(a: Column | str, b: Column | str) -> Column:
    """True, false, or null where a unit is unknown; a missing unit fits any."""
    return once(F.struct(canonical_unit(a).alias("x"), canonical_unit(b).alias("y")), _compatible)


def _compatible(units: Column) -> Column:
    x, y = units["x"], units["y"]
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).when((x == "") | (y == ""), True).otherwise(x == y)


def is_decimal_scaled(a: Column, b: Column) -> Column:
    """Whether two numbers differ by a power of ten of 10 or more (relative tolerance 1e-6)."""
    ratio = F.greatest(F.abs(a), F.abs(b)) / F.nullif(F.least(F.abs(a), F.abs(b)), F.lit(0.0))

    def near(r: Column) -> Column:
        power = F.round(F.log10(r))
        return (power >= 1) & (F.abs(r - F.pow(F.lit(10.0), power)) <= 1e-6 * F.greatest(r, F.pow(F.lit(10.0), power)))

    return F.coalesce(once(ratio, near), F.lit(False))


def compare_attribute(a_value: Column, a_unit: Column, b_value: Column, b_unit: Column) -> Column:
    """True if equal, false if different, null if code cannot tell.  Values and units are read once each."""
    unknown = F.lit(None).cast("boolean")

    def numeric(n: Column) -> Column:
        x, y = n["x"], n["y"]

        def fit(units: Column) -> Column:
            one_missing = (units["x"] == "") | (units["y"] == "")
            scaled = F.when(one_missing & is_decimal_scaled(x, y), unknown).otherwise(False)
            return F.when(_compatible(units), F.when(x == y, True).otherwise(scaled)).otherwise(unknown)

        return once(F.struct(canonical_unit(a_unit).alias("x"), canonical_unit(b_unit).alias("y")), fit)

    text = once(F.struct(squeeze(a_value.cast("string")).alias("s"), squeeze(b_value.cast("string")).alias("t")), lambda v: F.when((v["s"] != "") & (v["s"] == v["t"]), True).otherwise(unknown))
    read = once(F.struct(_trimmed(a_value).alias("x"), _trimmed(b_value).alias("y")), lambda v: F.struct(_number(v["x"]).alias("x"), _number(v["y"]).alias("y")))
    return once(read, lambda n: F.when(n["x"].isNotNull() & n["y"].isNotNull(), numeric(n)).otherwise(text))


def fixed(number: Column | str, places: int) -> Column:
    """A double as text with ``places`` digits behind the point, rounded as C's printf does: by its exact binary value, halves to even.

    The number's upper and lower bits are multiplied apart, which is exact, so the sign of what is above a half is right.
    Numbers of 10**12 and more, and those that are not finite, are left to Java.
    """
    x, scale = _col(number).cast("double"), 10**places
    size = F.abs(x)
    wide = size * 134217729.0
    upper = wide - (wide - size)
    whole = F.floor(size * scale)
    above = (upper * scale - whole - 0.5) + (size - upper) * scale
    n = whole + F.when((above > 0) | ((above == 0) & (whole % 2 == 1)), 1).otherwise(0)
    digits = F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(places + 1)), F.lit("0"))
    text = F.concat(F.when((x < 0), "-").otherwise(""), F.substring(digits, F.lit(1), F.length(digits) - places), F.lit("."), F.right(digits, F.lit(places)))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(size < 1e12, text).otherwise(F.format_string(f"%.{places}f", x))
