"""Number and date column functions. All are NULL-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderweave import fixed_values as fv
from orderweave.functions.text import strip

# Patterns of dates, and where year, month and day stand.
_DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "-", (1, 2, 3)),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ".", (3, 2, 1)),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "/", (3, 2, 1)),
)
_FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _date(c: Column, form: tuple[str, str, tuple[int, ...]]) -> Column:
    pattern, mark, places = form
    parts = [F.split_part(c, F.lit(mark), F.lit(place)) for place in places]
    return F.when(c.rlike(pattern), F.concat_ws("-", *parts).try_cast("date"))


def german_number(c: Column) -> Column:
    """``2.400`` is 2400 and ``3,95`` is 3.95."""
    plain = F.replace(F.replace(strip(c), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def german_date(c: Column) -> Column:
    return _date(strip(c), _DATE_FORMS[1])


def any_date(c: Column) -> Column:
    """First of year-first, dotted and slashed day-first dates that parses."""
    text = strip(c)
    return F.coalesce(*[_date(text, form) for form in _DATE_FORMS])


def week_date(c: Column, year: Column) -> Column:
    """Monday of a calendar week note (``KW 38`` or ``KW 38/2026``), ISO weeks."""
    week = F.regexp_extract(c, fv.CALENDAR_WEEK, 1).try_cast("int")
    noted = F.regexp_extract(c, fv.CALENDAR_WEEK, 2).try_cast("int")
    in_year = F.coalesce(noted, year)
    first = F.date_trunc("week", F.make_date(in_year, F.lit(1), F.lit(4))).cast("date")
    monday = F.date_add(first, (week - 1) * 7)
    # Week 53 exists only when its Thursday still lies in that year.
    thursday = F.date_add(monday, 3)
    return F.when(week.between(1, 53) & (F.year(thursday) == in_year), monday)


def lenient_float(c: Column) -> Column:
    """A number, or a text with decimal comma or point; NULL when neither."""
    text = strip(F.replace(c, F.lit(","), F.lit(".")))
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def millimetres(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(".")).try_cast("double")


def representable(c: Column) -> Column:
    """Is the number finite and within the digits of a message?"""
    return ~F.isnan(c) & (F.abs(c) < F.lit(1e20))


def quantity_text(c: Column) -> Column:
    """Integral values without decimals, others with up to three.

    Rounds the printed decimal value half to even, so only values with four or
    more decimals can differ from rounding the binary value. NULL where
    ``representable`` is false.
    """
    rounded = F.bround(c.try_cast("decimal(38,18)"), 3).cast("decimal(38,3)").cast("string")
    return F.when(c == F.floor(c), c.try_cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_replace(rounded, r"\.?0+$", ""))


def message_date(value: Column, *fallbacks: Column) -> Column:
    return F.date_format(F.coalesce(value, *fallbacks), "yyyyMMdd")
