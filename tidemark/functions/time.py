"""Civil time at a fixed offset of nine hours, without daylight saving. Timestamps are UTC."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_HOURS, DAY_CUT_HOUR = 9, 7
#: Weekday labels, Sunday first.
WEEKDAYS = ("日", "月", "火", "水", "木", "金", "土")


def local(ts: Column) -> Column:
    """Wall-clock time at the offset."""
    return ts + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")


def local_date(ts: Column) -> Column:
    return local(ts).cast("date")


def local_time(ts: Column) -> Column:
    return F.date_format(local(ts), "HH:mm")


def to_utc(wall: Column) -> Column:
    """The instant of a wall-clock time."""
    return wall - F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")


def iso(ts: Column) -> Column:
    """ISO 8601 in UTC with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def business_day(ts: Column) -> Column:
    """The day whose window [07:00 the day before, 07:00) holds the instant."""
    return F.date_add((ts + F.expr(f"INTERVAL {OFFSET_HOURS - DAY_CUT_HOUR} HOURS")).cast("date"), 1)


def window_of(day: date, days: int = 1) -> tuple[datetime, datetime]:
    """The half-open window of `days` days that ends at the day's cut, in UTC."""
    end = datetime(day.year, day.month, day.day, DAY_CUT_HOUR) - timedelta(hours=OFFSET_HOURS)
    return end - timedelta(days=days), end


def weekday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def header_date(day: Column) -> Column:
    """Month/day and weekday label, as in 9/13(日)."""
    labels = F.array(*map(F.lit, WEEKDAYS))
    return F.concat(F.month(day).cast("string"), F.lit("/"), F.dayofmonth(day).cast("string"), F.lit("("), F.element_at(labels, weekday(day) + 1), F.lit(")"))


def valid_date(text: Column) -> Column:
    """The date of a string of the shape YYYY-MM-DD that names a day of the years 100 to 9999; else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~text.startswith("00"), text).try_cast("date")


def _ymd(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int"))
    return F.when(year.try_cast("int").isNotNull(), valid_date(text))


# Era, kanji and delimited dates.
_ERA = r"(?:令和|[Rr])\s*(元|\d{1,2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
_KANJI = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
_DELIMITED = r"(\d{4})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{1,2})"
_ERA_BASE_YEAR = 2018


def page_date(text: Column) -> Column:
    """The first date in a text, the era form before the others; null where the first form found names no real day."""
    first = lambda pattern: F.regexp_extract(text, pattern, 0)
    found = F.coalesce(*(F.nullif(first(p), F.lit("")) for p in (_ERA, _KANJI, _DELIMITED)))
    # the match is short: what is between its numbers goes, and the era's first year is 1
    parts = F.split(F.regexp_replace(F.regexp_replace(found, "元", "1"), "[^0-9]+", " "), " ")
    numbers = F.filter(parts, lambda x: x != "")
    era = found.rlike("^(令和|[Rr])")
    year = F.get(numbers, 0).try_cast("int") + F.when(era, _ERA_BASE_YEAR).otherwise(0)
    return _ymd(year.cast("string"), F.get(numbers, 1), F.get(numbers, 2))


def compact_date(text: Column) -> Column:
    """YYYY-M-D, YYYY/M/D or YYYYMMDD as a date; else null."""
    plain = F.when(text.rlike(r"^\d{4}([-/]\d{1,2}[-/]\d{1,2}|\d{4})$"), text)
    delimited = plain.rlike("[-/]")
    parts = F.split(plain, "[-/]")
    pick = lambda k, at, n: F.when(delimited, F.get(parts, k)).otherwise(F.substr(plain, F.lit(at), F.lit(n)))
    return _ymd(pick(0, 1, 4), pick(1, 5, 2), pick(2, 7, 2))
