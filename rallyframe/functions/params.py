"""Checks of run parameters given as text, for whole tables of requests: a value where valid, else null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.functions.text import strip

#: Seasons that can be asked for, and the longest window in days (fixed values).
FIRST_YEAR, LAST_YEAR = 2000, 2030
LONGEST_WINDOW, ROLLING_DEFAULT = 400, 15


def strict_int(c: Column) -> Column:
    s = strip(c)
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("int"))


def _between(c: Column, low: int, high: int, blank: Column | None) -> Column:
    n = strict_int(c)
    valid = F.when(n.between(low, high), n)
    return valid if blank is None else F.when(F.coalesce(strip(c), F.lit("")) == "", blank).otherwise(valid)


def year(c: Column, current: Column | None = None) -> Column:
    """A season; blank means ``current`` brought into the range, if given."""
    return _between(c, FIRST_YEAR, LAST_YEAR, None if current is None else F.least(F.greatest(current, F.lit(FIRST_YEAR)), F.lit(LAST_YEAR)))


def month(c: Column, all_if_blank: bool = False) -> Column:
    """1 to 12, or 0 for the whole year."""
    return _between(c, 0, 12, F.lit(0) if all_if_blank else None)


def rolling_days(c: Column) -> Column:
    return _between(c, 1, LONGEST_WINDOW, F.lit(ROLLING_DEFAULT))


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd and nothing else."""
    s = strip(c)
    return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s.try_cast("date"))


def window_fits(start: Column, end: Column) -> Column:
    """Whether a window is in order and not longer than the longest one; false where a date is missing."""
    return F.coalesce((start <= end) & (F.date_diff(end, start) <= LONGEST_WINDOW), F.lit(False))


def choice(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(s == "", default).when(s.isin(*allowed), s)


def seconds_of_day(c: Column, fallback: Column) -> Column:
    """Seconds since midnight of H:MM or H:MM:SS; the fallback for anything else."""
    s = strip(c)
    part = [F.coalesce(F.regexp_extract(s, r"^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?$", i).try_cast("int"), F.lit(0)) for i in (1, 2, 3)]
    valid = s.rlike(r"^[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?$") & (part[0] < 24) & (part[1] < 60) & (part[2] < 60)
    return F.when(valid, part[0] * 3600 + part[1] * 60 + part[2]).otherwise(fallback)
