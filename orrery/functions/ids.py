"""Identifiers that encode a date, and dates written for people.

id = (year - 1800) * 10 000 000 + (month - 1) * 625 000 + (day - 1) * 15 625 + 4 * number
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the encoding.
YEAR, MONTH, DAY, NUMBER, FIRST_YEAR = 10_000_000, 625_000, 15_625, 4, 1800
#: Above every identifier; stands for an open upper end.
OPEN_END = 4_000_000_000


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("bigint")


def id_year(id_: Column) -> Column:
    return _div(id_, YEAR) + FIRST_YEAR


def id_month(id_: Column) -> Column:
    return _div(id_ % YEAR, MONTH) + 1


def id_day(id_: Column) -> Column:
    return _div(id_ % MONTH, DAY) + 1


def id_date(id_: Column) -> Column:
    """The day of an identifier. A month after the twelfth or a day after the month's last runs on into the next year or month, as the
    boundary after a month's last day does."""
    first = F.make_date(id_year(id_).cast("int"), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, (id_month(id_) - 1).cast("int")), (id_day(id_) - 1).cast("int"))


def date_id(day: Column, number: Column | int = 0) -> Column:
    """The identifier of the number-th paper of a day."""
    n = F.lit(number) if isinstance(number, int) else number
    return ((F.year(day) - FIRST_YEAR) * F.lit(YEAR).cast("bigint") + (F.month(day) - 1) * MONTH + (F.dayofmonth(day) - 1) * DAY + n * NUMBER).cast("bigint")


def days_ago(id_: Column, as_of: Column) -> Column:
    """Whole days from an identifier's day to ``as_of`` (a date), which is an argument so that results repeat."""
    return F.datediff(as_of, id_date(id_)).cast("bigint")


def age_in_range(id_: Column, start: Column, end: Column) -> Column:
    """0 at ``start``, 1 at ``end``; null if the range is a point."""
    return F.when(end != start, (id_ - start).cast("double") / (end - start))


def spoken_date(text: Column) -> Column:
    """``Y-M-D`` as ``D MonthName Y``; any other text unchanged."""
    parts = F.split(text, "-")
    whole = text.rlike("^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$")
    day = F.try_make_timestamp(parts[0].try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int"), F.try_element_at(parts, F.lit(3)).try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return F.when(whole & day.isNotNull(), F.date_format(day, "d MMMM yyyy")).otherwise(text)
