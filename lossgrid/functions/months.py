"""Calendar arithmetic on integer months written as YYYYMM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ym_year(c: Column | str) -> Column:
    return F.call_function("div", _col(c), F.lit(100)).cast("int")


def ym_index(c: Column | str) -> Column:
    """Months since year 0, so that a difference of two indexes is a number of months."""
    c = _col(c)
    return ym_year(c) * 12 + c % 100 - 1


def index_to_ym(i: Column) -> Column:
    return (F.call_function("div", i, F.lit(12)) * 100 + i % 12 + 1).cast("int")


def ym_add(c: Column | str, months: int | Column) -> Column:
    return index_to_ym(ym_index(c) + months)


def ym_to_date(c: Column | str) -> Column:
    """First day of the month."""
    c = _col(c)
    return F.make_date(ym_year(c), (c % 100).cast("int"), F.lit(1))


def date_to_ym(c: Column | str) -> Column:
    c = _col(c)
    return (F.year(c) * 100 + F.month(c)).cast("int")
