"""Date, number and label expressions. Unreadable text gives null or the empty string, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyframe.functions.text import blank, collapse, strip, tidy

#: The date spellings of identity keys, in the order they are tried.
IDENTITY_FORMATS = ("yyyy-M-d", "M/d/yyyy", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yy")
MONTHS = "January February March April May June July August September October November December".split()


def read_date(c: Column, pattern: str) -> Column:
    """A date by one pattern; years of two digits from 69 on are of the last century."""
    d = F.try_to_timestamp(c, F.lit(pattern)).cast("date")
    if "yy" in pattern and "yyyy" not in pattern:
        d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    return d


def first_date(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[read_date(c, f) for f in formats])


def _date_by_sign(c: Column, formats: tuple[str, ...]) -> Column:
    """As ``first_date``; formats whose separator the text lacks are not tried."""
    return F.coalesce(*[F.when(c.contains(next(s for s in "-/," if s in f)), read_date(c, f)) for f in formats])


def identity_date(c: Column) -> Column:
    """ISO date of the first spelling that fits, else the lower-cased text."""
    # read once: each format would make the spaces anew
    return F.transform(F.array(tidy(c)), lambda raw: F.coalesce(F.date_format(_date_by_sign(raw, IDENTITY_FORMATS), "yyyy-MM-dd"), F.lower(raw)))[0]


def us_date(c: Column, formats: tuple[str, ...], otherwise: str | None = "") -> Column:
    """MM/dd/yyyy of the first spelling that fits, else blank (or, with None, the text itself)."""
    raw = strip(c)
    return F.coalesce(F.date_format(first_date(raw, formats), "MM/dd/yyyy"), raw if otherwise is None else F.lit(otherwise))


def iso_prefix_date(c: Column) -> Column:
    """MM/dd/yyyy of text that begins with an ISO date; placeholder years up to 1 are blank."""
    d = F.try_to_timestamp(F.regexp_extract(strip(c), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(d) > 1, F.date_format(d, "MM/dd/yyyy")).otherwise("")


def feed_date(c: Column) -> Column:
    """ISO date of feed spellings with or without a clock time, else the text."""
    raw = strip(c)
    d = first_date(raw, ("M/d/yyyy h:mm:ss a", "M/d/yyyy", "M/d/yy", "yyyy-M-d", "yyyy-M-d'T'H:m:s"))
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), raw)


def epoch_or_iso(c: Column) -> Column:
    """Date of ``/Date(ms)/`` or ISO text."""
    ms = F.try_to_number(F.nullif(F.regexp_extract(blank(c), r"/Date\((-?\d{1,15})", 1), F.lit("")), F.lit("S999999999999999")).cast("bigint")
    return F.coalesce(F.timestamp_millis(ms).cast("date"), F.try_to_timestamp(F.regexp_extract(blank(c), r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd")).cast("date"))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-M-d")).cast("date")


_ISO_RANGE = r"^(\d{4}-\d{2}-\d{2})\s*-\s*(\d{4}-\d{2}-\d{2})$"
_DOTTED_RANGE = r"^(\d{1,2})\.\s*(\d{1,2})\.?\s*(\d{4})?\s*[-–]\s*(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})$"


def date_range(c: Column) -> Column:
    """struct(start, end) of ``2024-04-21 - 2024-04-22`` or ``28. 11.-2. 12. 2025``; the end's year serves both."""
    s = strip(c)
    iso = s.rlike(_ISO_RANGE)
    one = [F.try_to_timestamp(F.regexp_extract(s, _ISO_RANGE, i), F.lit("yyyy-MM-dd")).cast("date") for i in (1, 2)]
    g = [F.regexp_extract(s, _DOTTED_RANGE, i) for i in range(1, 7)]
    start = _ymd(F.coalesce(F.nullif(g[2], F.lit("")), g[5]), g[1], g[0])
    return F.struct(F.when(iso, one[0]).otherwise(start).alias("start"), F.when(iso, one[1]).otherwise(_ymd(g[5], g[4], g[3])).alias("end"))


_EUROPEAN = r"^(\d{1,2})\.\s*(\d{1,2})?\.?\s*-\s*(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})$"
_EUROPEAN_DAY = r"^(\d{1,2})\.\s*(\d{1,2})\.\s*(\d{4})$"


def european_range(c: Column) -> Column:
    """struct(start, end) of ``18.-20. 4. 2026`` and its longer forms; over New Year the start is a year earlier."""
    s = collapse(c)
    g = [F.regexp_extract(s, _EUROPEAN, i) for i in range(1, 6)]
    month = F.coalesce(F.nullif(g[1], F.lit("")), g[3])
    start, end = _ymd(g[4], month, g[0]), _ymd(g[4], g[3], g[2])
    earlier = F.when(start > end, F.add_months(start, -12)).otherwise(start)
    day = _ymd(*(F.regexp_extract(s, _EUROPEAN_DAY, i) for i in (3, 2, 1)))
    single = s.rlike(_EUROPEAN_DAY)
    return F.struct(F.when(single, day).otherwise(earlier).alias("start"), F.when(single, day).otherwise(end).alias("end"))


def dates_in_text(c: Column) -> Column:
    """struct(first, last) over the dd/mm/yyyy and yyyy-mm-dd dates in a text, in order of place."""
    found = F.regexp_extract_all(blank(c), F.lit(r"\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2}"), F.lit(0))
    dates = F.filter(F.transform(found, lambda t: first_date(t, ("d/M/yyyy", "yyyy-MM-dd"))), lambda d: d.isNotNull())
    return F.struct(F.try_element_at(dates, F.lit(1)).alias("first"), F.try_element_at(dates, F.lit(-1)).alias("last"))


def _spelt(c: Column, year: Column) -> Column:
    with_year = F.when(c.rlike(r"\d{4}"), c).otherwise(F.concat_ws(" ", c, year.cast("string")))
    return first_date(with_year, ("d MMMM yyyy", "d MMM yyyy", "MMMM d yyyy", "MMM d yyyy"))


def range_with_year(c: Column, default_year: Column) -> Column:
    """struct(start, end) of ``3 May - 5 June`` with a default year where none is written."""
    parts = F.split(strip(c), r"\s+(?:-|–|to)\s+", 2)
    start = _spelt(parts[0], default_year)
    end = F.when(F.size(parts) > 1, _spelt(F.try_element_at(parts, F.lit(2)), default_year)).otherwise(start)
    return F.struct(start.alias("start"), end.alias("end"))


def range_as_of(c: Column, as_of: Column) -> Column:
    """As ``range_with_year`` where a range over New Year without years begins in the year before ``as_of``'s; a year on one side serves both."""
    s = F.regexp_replace(strip(c), " - ", " to ")
    parts = F.split(s, " to ", 2)
    a, b = parts[0], F.when(F.size(parts) > 1, F.try_element_at(parts, F.lit(2))).otherwise(parts[0])
    year_a, year_b = (F.try_to_number(F.nullif(F.regexp_extract(x, r"(\d{4})", 1), F.lit("")), F.lit("9999")).cast("int") for x in (a, b))
    now = F.year(as_of)
    m_a, m_b = F.month(_spelt(a, F.lit(2000))), F.month(_spelt(b, F.lit(2000)))
    start_year = F.coalesce(year_a, F.when(m_a > m_b, F.coalesce(year_b, now) - 1).otherwise(F.coalesce(year_b, now)))
    end_year = F.coalesce(year_b, year_a, now)
    return F.struct(_spelt(a, start_year).alias("start"), _spelt(b, end_year).alias("end"))


def spelt_range_start(c: Column) -> Column:
    """ISO start of ``16 - 21 June 2025``, ``31 January - 28 February 2025``, ``31 January February 2025`` or one day; blank if unreadable."""
    s = strip(c)
    months = "|".join(MONTHS)
    same = F.regexp_replace(s, rf"^(\d{{1,2}}) - \d{{1,2}} ({months}) (\d{{4}})$", "$1 $2 $3")
    cross = F.regexp_replace(same, rf"^(\d{{1,2}}) ({months}) - \d{{1,2}} (?:{months}) (\d{{4}})$", "$1 $2 $3")
    two = F.regexp_replace(cross, rf"^(\d{{1,2}}) ({months}) (?:{months}) (\d{{4}})$", "$1 $2 $3")
    return F.coalesce(F.date_format(F.try_to_timestamp(two, F.lit("d MMMM yyyy")), "yyyy-MM-dd"), F.lit(""))


def whole_number(c: Column, digits: int) -> Column:
    """An int of up to ``digits`` digits, ``7.0`` accepted."""
    return F.try_to_number(F.nullif(F.regexp_extract(strip(c), rf"^(\d{{1,{digits}}})(?:\.0+)?$", 1), F.lit("")), F.lit("9" * digits)).cast("int")


def past_date(day: Column, month: Column, year: Column, as_of: Column) -> Column:
    """MM/dd/yyyy of three number texts; blank for impossible dates, before 1900 and after ``as_of``."""
    d, m, y = whole_number(day, 2), whole_number(month, 2), whole_number(year, 4)
    date = _ymd(y.cast("string"), m.cast("string"), d.cast("string"))
    return F.when((y >= 1900) & (date <= as_of), F.date_format(date, "MM/dd/yyyy")).otherwise("")


def lenient_int(c: Column) -> Column:
    s = strip(c)
    return F.coalesce(s.try_cast("int"), F.when(F.abs(s.try_cast("double")) < 2**31, s.try_cast("double")).cast("int"), F.lit(0))


def lenient_bool(c: Column) -> Column:
    return F.lower(strip(c)).isin("1", "true", "yes", "y", "t")


def clamp_day(month: Column, day: Column) -> Column:
    """The day of a month, or its last one, as a date."""
    first = F.trunc(month, "month")
    return F.date_add(first, F.least(day, F.day(F.last_day(first))) - 1)


def next_weekday(d: Column, weekday: Column) -> Column:
    """The first date on or after ``d`` on a weekday (Monday 0)."""
    return F.date_add(d, F.pmod(weekday - F.weekday(d), F.lit(7)))


def _at(d: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(d.cast("timestamp")) + seconds)


def next_run(frequency: Column, seconds: Column, weekday: Column, day: Column, anchor: Column, after: Column) -> Column:
    """The next due instant strictly after ``after`` of a daily, weekly, biweekly or (any other value) monthly schedule, in UTC."""
    today = after.cast("date")

    def later(d, step):
        return F.when(_at(d, seconds) > after, _at(d, seconds)).otherwise(_at(step, seconds))

    week = next_weekday(today, weekday)
    start = next_weekday(F.coalesce(anchor, today), weekday)
    days = F.date_diff(today, start)
    fortnight = F.when(days <= 0, start).otherwise(F.date_add(start, (F.ceil(days / 14) * 14).cast("int")))
    month = clamp_day(today, day)
    return F.when(frequency == "daily", later(today, F.date_add(today, 1))).when(frequency == "weekly", later(week, F.date_add(week, 7))).when(frequency == "biweekly", later(fortnight, F.date_add(fortnight, 14))).otherwise(later(month, clamp_day(F.add_months(F.trunc(today, "month"), 1), day)))


def first_anchor(seconds: Column, weekday: Column, after: Column) -> Column:
    d = next_weekday(after.cast("date"), weekday)
    return F.when(_at(d, seconds) > after, d).otherwise(F.date_add(d, 7))


def lookback_days(c: Column) -> Column:
    return F.when(c.isin(*range(5, 50, 5)), c).otherwise(15)


def duration_label(ms: Column) -> Column:
    n = F.coalesce(ms, F.lit(0))
    s = F.bround(n / 1000).cast("bigint")
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" ms"))).when(n < 60000, F.format_string("%.1fs", n / 1000)).otherwise(F.format_string("%dm %02ds", (s / 60).cast("bigint"), s % 60))


def size_label(size: Column) -> Column:
    n = F.coalesce(size, F.lit(0))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def progress_percent(done: Column, total: Column) -> Column:
    return F.least(F.lit(100), F.coalesce(F.bround(F.try_divide(done * 100, total)).cast("int"), F.lit(0)))


def eta_seconds(running: Column, done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the average rate so far; null when it can't be told."""
    known = running & (total > 0) & (done > 0) & (elapsed > 0)
    return F.when(known & (total <= done), 0.0).when(known, (total - done) / (done / elapsed))


def eta_label(seconds: Column) -> Column:
    s = F.bround(seconds).cast("bigint")
    m = F.floor(s / 60)
    return F.when(seconds.isNull(), "").when(seconds <= 0, "finishing…").when(s < 60, F.format_string("~%ds left", F.greatest(s, F.lit(1)))).when(m < 60, F.format_string("~%dm %02ds left", m, s % 60)).otherwise(F.format_string("~%dh %02dm left", F.floor(m / 60), m % 60))


def clamped(c: Column, low: int, high: int, default: int) -> Column:
    """Within bounds; zero and null read as the default."""
    return F.greatest(F.lit(low), F.least(F.coalesce(F.nullif(c, F.lit(0)), F.lit(default)), F.lit(high)))


def backoff(attempt: Column, base: float, cap: float) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))


def percent(used: Column, total: Column) -> Column:
    return F.round(F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(used * 100.0, total))), F.lit(0.0)), 1)


def birth_date(dob: Column, year: Column) -> Column:
    """MM/dd/yyyy of a day-first date, else ``1/1/`` and the year of birth."""
    d = us_date(dob, ("d/M/yyyy",))
    return F.when(d != "", d).when(strip(year) != "", F.concat(F.lit("1/1/"), strip(year))).otherwise("")


def year_in_text(c: Column) -> Column:
    y = F.regexp_extract(blank(c), r"(?:19|20)\d{2}", 0)
    return F.when(y != "", F.concat(F.lit("1/1/"), y)).otherwise("")


def one_or_two_dates(c: Column) -> Column:
    """struct(start, end) of the first two dd/mm/yyyy dates; one date is both."""
    found = F.regexp_extract_all(blank(c), F.lit(r"\d{1,2}/\d{1,2}/\d{4}"), F.lit(0))
    start = us_date(F.try_element_at(found, F.lit(1)), ("d/M/yyyy",))
    return F.struct(start.alias("start"), F.when(F.size(found) > 1, us_date(F.try_element_at(found, F.lit(2)), ("d/M/yyyy",))).otherwise(start).alias("end"))


def default_year(name: Column, run_year: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(blank(name), r"\b((?:19|20)\d{2})\b", 1), F.lit("")), F.lit("9999")).cast("int"), run_year)


def locale_date(c: Column, day_first: bool) -> Column:
    first, second = ("d/M/yyyy", "M/d/yyyy") if day_first else ("M/d/yyyy", "d/M/yyyy")
    return first_date(strip(c), (first, second, "yyyy-M-d"))


def in_window(d: Column, start: Column, end: Column, keep_unknown: bool) -> Column:
    """Date within bounds; the policy for missing dates is the caller's."""
    return F.coalesce(d.between(start, end), F.lit(keep_unknown))


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Range touches the window; a missing end is the start, a missing start is kept."""
    return F.coalesce((start <= high) & (F.coalesce(end, start) >= low), F.lit(True))


def inside(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.coalesce((start >= low) & (end <= high), F.lit(False))


def line_count(c: Column) -> Column:
    """Lines of a CSV text without its header."""
    lines = F.size(F.split(F.regexp_replace(blank(c), r"\r?\n$", ""), r"\r?\n"))
    return F.when(blank(c) == "", 0).otherwise(F.greatest(F.lit(0), lines - 1))
