"""Column functions on dates written in several ways, and on how old something is. Today is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"(?:^|\D)(\d{4})-(\d{1,2})-(\d{1,2})(?:\D|$)"
US = r"(?:^|\D)(\d{1,2})[/-](\d{1,2})[/-](\d{4}|\d{2})(?:\D|$)"
REVISED = r"(?i)\brev(?:ised)?\.?\s*(\d{1,2})[/-](\d{4}|\d{2})(?:\D|$)"
YEAR = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"


def _number(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit("")).try_cast("int")


def _four(year: Column) -> Column:
    return F.when(year < 100, year + 2000).otherwise(year)


def date_key(c: Column) -> Column:
    """(y, m, d) of the first date of a text: ISO, month/day/year, a revision's month/year, or a bare year; 0 for what is not said; null without one."""
    key = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
    zero = F.lit(0)
    return (
        F.when(c.rlike(ISO), key(_number(c, ISO, 1), _number(c, ISO, 2), _number(c, ISO, 3)))
        .when(c.rlike(US), key(_four(_number(c, US, 3)), _number(c, US, 1), _number(c, US, 2)))
        .when(c.rlike(REVISED), key(_four(_number(c, REVISED, 2)), _number(c, REVISED, 1), zero))
        .when(c.rlike(YEAR), key(_number(c, YEAR, 1), zero, zero))
    )


def is_stale(at: Column, today: Column, months: int = 18) -> Column:
    """Whether a moment is more than so many months before today; null for a null moment."""
    return at < F.add_months(today, -months)


def currency_note(at: Column, today: Column, superseded_by: Column, exempt: Column, months: int = 18) -> Column:
    """What is to be said of how current something is; empty if nothing is."""
    return (
        F.when(superseded_by.isNotNull(), F.concat(F.lit("superseded by "), superseded_by.cast("string")))
        .when(~exempt & is_stale(at, today, months), F.concat(F.lit("not checked since "), F.date_format(at, "yyyy-MM-dd")))
        .otherwise("")
    )
