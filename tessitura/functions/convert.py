"""Conversions between types, over single data: as Columns, and as Python for constants.

Numbers in Columns are DECIMAL(38,9). Text may hold more places than that; a number read from text is therefore
WIDE, a struct of its whole part and its fraction, which Spark orders as the number it is.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.numbers import LIMIT, canonical, fits
from ..plans.syntax import BYTE_UNITS, only_literal

NARROW = "decimal(38,9)"
WHOLE, PART = "decimal(29,0)", "decimal(28,28)"
UNITS = ("bytecount", "duration")
NUMERIC = ("number", *UNITS)


def constant(value: object, source: str, target: str) -> object | None:
    """A constant converted; None if it can't be."""
    if source == "string":
        token = only_literal(value)
        if token is None or token.kind not in ("number", target):
            return None
        return _as_unit(token.value, target if token.kind == "number" else "")
    if target == "string":
        return canonical(value) + {"duration": "s", "bytecount": "b"}.get(source, "")
    return _as_unit(value, target)


def _as_unit(value: Decimal, target: str) -> Decimal | None:
    if target in UNITS and (value < 0 or target == "duration" and value != value.to_integral_value()):
        return None
    return value


def narrow_enough(value: Decimal) -> bool:
    return -value.as_tuple().exponent <= 9


def number(value: Decimal, wide: bool) -> Column:
    if not wide:
        return F.lit(value).cast(NARROW)
    whole = value.to_integral_value(rounding="ROUND_DOWN")
    return F.struct(F.lit(whole).cast(WHOLE).alias("i"), F.lit(value - whole).cast(PART).alias("f"))


def widened(c: Column) -> Column:
    c = c.cast(NARROW)
    whole = F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast(WHOLE)
    part = c % F.lit(1).cast("decimal(1,0)")  # a difference would lose the last place
    return F.when(c.isNotNull(), F.struct(whole.alias("i"), part.cast(PART).alias("f")))


def _wide(digits: Column, places: Column, negative: Column) -> Column:
    """A wide number from its digits before and after the point; null if it can't be held exactly."""
    places = F.regexp_replace(places, "0+\\z", "")
    digits = F.regexp_replace(digits, "^0+", "")
    total = F.regexp_replace(F.concat(digits, places), "^0+", "")
    fit = (F.length(places) <= 28) & ((F.length(total) < 29) | (F.length(total) == 29) & (total <= str(LIMIT - 1)))
    sign = F.when(negative, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    whole = (sign * F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).try_cast("decimal(36,0)")).try_cast(WHOLE)
    part = (sign * F.concat(F.lit("0."), F.coalesce(F.nullif(places, F.lit("")), F.lit("0"))).try_cast("decimal(36,28)")).try_cast(PART)
    return F.when(fit & whole.isNotNull() & part.isNotNull(), F.struct(whole.alias("i"), part.alias("f")))


_NUMBER = r"^([+-]?)([0-9]*)(?:\.([0-9]+))?\z"


def _group(c: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(c, pattern, k)


def number_from_text(c: Column) -> Column:
    """Text that is a number literal and nothing else. Whole numbers of a long and what a narrow decimal holds are cast;
    only longer text is taken apart."""
    small = c.rlike(r"^[+-]?[0-9]{1,18}\z")
    shaped = c.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\z")
    short = c.rlike(r"^[+-]?(?:[0-9]{1,20}(?:\.[0-9]{1,9})?|\.[0-9]{1,9})\z")
    long = _wide(_group(c, _NUMBER, 2), _group(c, _NUMBER, 3), _group(c, _NUMBER, 1) == "-")
    whole = F.struct(c.try_cast("bigint").cast(WHOLE).alias("i"), F.lit(Decimal(0)).cast(PART).alias("f"))
    return F.when(small, whole).when(shaped, F.when(short, widened(c.try_cast(NARROW))).otherwise(long))


def _integer(c: Column, pattern: str, k: int, by: int = 1) -> Column:
    return F.coalesce(F.nullif(_group(c, pattern, k), F.lit("")), F.lit("0")).try_cast("decimal(30,0)") * F.lit(by).cast("decimal(4,0)")


def _whole(total: Column) -> Column:
    fit = total < F.lit(Decimal(LIMIT)).cast("decimal(38,0)")
    return F.when(fit, F.struct(total.try_cast(WHOLE).alias("i"), F.lit(Decimal(0)).cast(PART).alias("f")))


def duration_from_text(c: Column) -> Column:
    units = r"(?i)^(?:([0-9]+)h)?(?:([0-9]+)m)?(?:([0-9]+)s)?\z"
    clock = r"^([0-9]+):([0-5][0-9])(?::([0-5][0-9]))?\z"
    in_units = F.try_add(F.try_add(_integer(c, units, 1, 3600), _integer(c, units, 2, 60)), _integer(c, units, 3))
    short = F.try_add(_integer(c, clock, 1, 60), _integer(c, clock, 2))
    long = F.try_add(F.try_add(_integer(c, clock, 1, 3600), _integer(c, clock, 2, 60)), _integer(c, clock, 3))
    hours = _group(c, clock, 3) != ""
    return (
        F.when(c.rlike(units) & (c != ""), _whole(in_units))
        .when(c.rlike(clock), F.when(hours, _whole(long)).otherwise(_whole(short)))
        .otherwise(as_duration(number_from_text(c)))
    )


def bytecount_from_text(c: Column) -> Column:
    pattern = r"(?i)^([0-9]*)(?:\.([0-9]+))?(k|m|g|t|ki|mi|gi|ti|)b\z"
    unit = F.lower(_group(c, pattern, 3))
    shaped = c.rlike(r"(?i)^(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[kmgt]i?)?b\z")
    # The digits as one integer, times the unit, then the point put back: exact while 38 digits hold it.
    places = F.regexp_replace(_group(c, pattern, 2), "0+\\z", "")
    digits = F.concat(_group(c, pattern, 1), places)
    factor = F.lit(1).cast("decimal(13,0)")
    for name, by in BYTE_UNITS.items():
        factor = F.when(unit == name[:-1], F.lit(Decimal(by)).cast("decimal(13,0)")).otherwise(factor)
    whole = F.coalesce(F.nullif(digits, F.lit("")), F.lit("0"))
    product = F.when(unit == "", whole).otherwise(F.try_multiply(whole.try_cast("decimal(38,0)"), factor).cast("string"))
    padded = F.lpad(product, F.greatest(F.length(product), F.length(places) + 1), F.lit("0"))
    at = F.length(padded) - F.length(places)
    read = _wide(F.substring(padded, F.lit(1), at), F.substring(padded, at + 1, F.length(places)), F.lit(False))
    return F.when(shaped, read).otherwise(as_bytecount(number_from_text(c)))


def _sign_part(c: Column, wide: bool) -> tuple[Column, Column]:
    """Whether a number is not negative, and whether it is whole."""
    if wide:
        return (c["i"] >= 0) & (c["f"] >= 0), c["f"] == 0
    return c >= 0, c == F.floor(c)


def as_duration(c: Column, wide: bool = True) -> Column:
    positive, whole = _sign_part(c, wide)
    return F.when(positive & whole, c)


def as_bytecount(c: Column, wide: bool = True) -> Column:
    return F.when(_sign_part(c, wide)[0], c)


def text_of(c: Column, wide: bool, suffix: str = "") -> Column:
    if wide:
        # Fractions print with an exponent when small, so their digits are taken from whole numbers, half at a time.
        tens = F.lit(Decimal(10) ** 14).cast("decimal(15,0)")
        upper = F.floor(F.abs(c["f"]) * tens).cast("decimal(15,0)")
        lower = ((F.abs(c["f"]) * tens).cast("decimal(30,14)") - upper).cast("decimal(15,14)") * tens
        part = F.concat(F.lpad(upper.cast("string"), 14, "0"), F.lpad(lower.cast("decimal(15,0)").cast("string"), 14, "0"))
        part = F.regexp_replace(part, "0+\\z", "")
        whole = F.abs(c["i"]).cast("string")
        sign = F.when((c["i"] < 0) | (c["f"] < 0), "-").otherwise("")
        out = F.concat(sign, whole, F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    else:
        text = c.cast(NARROW).cast("decimal(38,9)").cast("string")
        out = F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+\\z", "$1"), "\\.\\z", "")
        out = F.when(c == 0, F.lit("0")).otherwise(out)
    return F.concat(out, F.lit(suffix)) if suffix else out


def converted(c: Column, source: str, target: str, wide: bool) -> tuple[Column, bool]:
    """One datum converted (null: it can't be), and whether the result is wide."""
    if source == "string":
        return {"number": number_from_text, "duration": duration_from_text, "bytecount": bytecount_from_text}[target](c), True
    if target == "string":
        return text_of(c, wide, {"duration": "s", "bytecount": "b"}.get(source, "")), False
    if target == "number":
        return c, wide
    return (as_duration if target == "duration" else as_bytecount)(c, wide), wide


__all__ = ["NARROW", "NUMERIC", "UNITS", "constant", "converted", "fits", "narrow_enough", "number", "widened"]
