"""Date helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_ws


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(month: Column) -> Column:
    return F.to_date(F.concat(month, F.lit("-01")))


def days_in_month(month: Column) -> Column:
    return F.dayofmonth(F.last_day(month_start(month))).cast("bigint")


def add_months_key(month: Column, delta: Column) -> Column:
    """Shift a YYYY-MM key by delta months."""
    return month_key(F.add_months(month_start(month), delta))


def days_between(first: Column, second: Column) -> Column:
    """second - first in days."""
    return F.datediff(second, first).cast("bigint")


def within_days(first: Column, second: Column, days: int) -> Column:
    return F.abs(F.datediff(second, first)) <= days


def normalize_date(text: Column) -> Column:
    """ISO, M/D/YYYY, YYYY/M/D and M/D/YY (below 80 means 20xx) -> ISO text, else null."""
    text = trim_ws(text)

    def iso(pattern: str, year: Column, month: int, day: int) -> Column:
        part = lambda i: F.lpad(F.regexp_extract(text, pattern, i), 2, "0")
        return F.when(text.rlike(pattern), F.concat_ws("-", year, part(month), part(day)))

    us = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
    slashed = r"^(\d{4})/(\d{1,2})/(\d{1,2})\z"
    short = r"^(\d{1,2})/(\d{1,2})/(\d{2})\z"
    two_digits = F.regexp_extract(text, short, 3)
    century = F.when(two_digits < "80", F.lit("20")).otherwise(F.lit("19"))
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}\z"), text),
        iso(us, F.regexp_extract(text, us, 3), 1, 2),
        iso(slashed, F.regexp_extract(text, slashed, 1), 2, 3),
        iso(short, F.concat(century, two_digits), 1, 2),
    )


def is_iso_date(text: Column) -> Column:
    """True only for a real calendar day written YYYY-MM-DD."""
    return F.coalesce(
        text.rlike(r"^\d{4}-\d{2}-\d{2}\z") & text.try_cast("date").isNotNull(), F.lit(False)
    )


def year_for_month(month: Column, start: Column, end: Column) -> Column:
    """Year of a MM/DD row: a period over two years splits at its start month."""
    crosses = F.year(start) != F.year(end)
    return F.when(crosses & (month >= F.month(start)), F.year(start)).otherwise(F.year(end))
