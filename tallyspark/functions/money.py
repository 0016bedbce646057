"""Money as integer cents: parsing, formatting and exact conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import trim_ws


def cents(price: Column) -> Column:
    """Whole cents of a double price; the only place a float becomes money."""
    return F.round(price * 100).cast("bigint")


def _whole_and_fraction(whole: Column, fraction: Column) -> Column:
    return (
        whole.try_cast("decimal(36,0)") * 100 + F.rpad(fraction, 2, "0").try_cast("decimal(2,0)")
    ).try_cast("bigint")


def parse_money(text: Column) -> Column:
    """Printed amount -> cents: $1,234.56, (x), -x, .50; null when unreadable."""
    text = trim_ws(text)
    in_parens = text.rlike(r"^\(\s*.+\s*\)\z")
    body = F.when(in_parens, F.regexp_replace(text, r"^\(|\)\z", "")).otherwise(text)
    pattern = (
        r"^\s*(-)?\s*\(?\s*\$?\s*(\d{1,3}(?:,\d{3})*|\d+)?(?:\.(\d{1,2}))?\s*\)?\s*\z"
    )
    whole = F.regexp_extract(body, pattern, 2)
    fraction = F.regexp_extract(body, pattern, 3)
    readable = (
        body.rlike(pattern)
        & ((whole != "") | (fraction != ""))
        & ~text.rlike(r"\(.*\(") & ~text.rlike(r"\).*\)")
    )
    digits = F.when(whole == "", F.lit("0")).otherwise(F.regexp_replace(whole, ",", ""))
    value = _whole_and_fraction(digits, fraction)
    negative = in_parens | (F.regexp_extract(body, pattern, 1) == "-")
    return F.when(readable, F.when(negative, -value).otherwise(value))


def plain_amount(text: Column) -> Column:
    """Trimmed CSV amount without its parentheses, blanks, currency signs and commas, led by n if it had parentheses, else p."""
    in_parens = text.rlike(r"^\(.*\)\z")
    body = F.when(in_parens, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    return F.concat(F.when(in_parens, F.lit("n")).otherwise(F.lit("p")), F.regexp_replace(body, r"[$£€¥₹,\s\u00a0]", ""))


def plain_value(plain: Column) -> Column:
    """Cents of a plain_amount; the third decimal digit alone decides the rounding."""
    pattern = r"^[np][-+]?(\d+)(?:\.(\d+))?\z"
    fraction = F.regexp_extract(plain, pattern, 2)
    # no match leaves no whole part, and that is no number
    value = _whole_and_fraction(F.regexp_extract(plain, pattern, 1), F.substring(fraction, 1, 2))
    value = value + F.when(F.substring(fraction, 3, 1) >= "5", F.lit(1)).otherwise(F.lit(0))
    negative = plain.startswith("n") != (F.substring(plain, 2, 1) == "-")
    return F.when(negative, F.lit(-1)).otherwise(F.lit(1)) * value


def parse_amount(text: Column) -> Column:
    """CSV amount -> cents; the third decimal digit alone decides the rounding."""
    return plain_value(plain_amount(trim_ws(text)))


def move_trailing_minus(text: Column) -> Column:
    """344.92- -> -344.92; other text only loses its outer blanks."""
    text = trim_ws(text)
    return F.regexp_replace(text, r"^([\d.,]+)-\z", "-$1")


def cents_to_decimal(amount: Column) -> Column:
    """Cents -> text like -12.34, without a float."""
    return (amount.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast(
        "decimal(20,2)"
    ).cast("string")


def _grouped(whole: Column, every: int) -> Column:
    return F.regexp_replace(whole, rf"\B(?=(\d{{{every}}})+(?!\d))", ",")


def format_money(amount: Column, currency: Column) -> Column:
    """Symbol and grouping by currency, sign first: -$1,234.50, ₹12,34,567.00."""
    # abs and integer division on decimals, so that the smallest bigint also formats
    magnitude = F.abs(amount.cast("decimal(20,0)"))
    digits = magnitude.cast("string")
    digits = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    whole = F.regexp_extract(digits, r"^(\d+)\d{2}$", 1)
    fraction = F.regexp_extract(digits, r"(\d{2})$", 1)
    head = F.regexp_extract(whole, r"^(\d+)\d{3}$", 1)
    indian = F.when(
        F.length(whole) > 3, F.concat(_grouped(head, 2), F.lit(","), F.substring(whole, -3, 3))
    ).otherwise(whole)
    symbol = F.lit("")
    for code, sign in fixed.CURRENCY_SYMBOLS.items():
        symbol = F.when(currency == code, F.lit(sign)).otherwise(symbol)
    return F.concat(
        F.when(amount < 0, F.lit("-")).otherwise(F.lit("")),
        symbol,
        F.when(currency == "INR", indian).otherwise(_grouped(whole, 3)),
        F.lit("."),
        fraction,
    )
