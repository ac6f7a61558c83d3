"""Exact decimals of 96 bits: what a number literal may be and how it is written canonically."""

from __future__ import annotations

from decimal import Context, Decimal

LIMIT = 2**96  # a value's digits, without the point, stay below it
PLACES = 28
_WIDE = Context(prec=200)


def exact(text: str) -> Decimal | None:
    """The value of a number literal; None if it can't be held exactly."""
    return fits(_WIDE.create_decimal(text))


def fits(value: Decimal) -> Decimal | None:
    sign, digits, exponent = value.as_tuple()
    whole = int("".join(map(str, digits)) or "0")
    while exponent < 0 and whole % 10 == 0:
        whole, exponent = whole // 10, exponent + 1
    whole, exponent = (whole * 10**exponent, 0) if exponent > 0 else (whole, exponent)
    if whole == 0:
        return Decimal(0)
    if whole >= LIMIT or -exponent > PLACES:
        return None
    return Decimal((sign, tuple(map(int, str(whole))), exponent))


def scaled(value: Decimal, by: int) -> Decimal | None:
    return fits(_WIDE.multiply(value, Decimal(by)))


def canonical(value: Decimal) -> str:
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "", "-") else text
