"""Numbers, shares, dates and durations for display, as Column expressions; missing values show as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "—"
MONTH_DAYS = 30.44


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def number(c: Column) -> Column:
    return F.format_number(c, 0)


def percent(c: Column) -> Column:
    return F.concat(half_up(c * 100).cast("string"), F.lit("%"))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def _utc(ms: Column, form: str) -> Column:
    return F.coalesce(F.date_format(F.timestamp_millis(ms), form), F.lit(MISSING))


def short_date(ms: Column) -> Column:
    """14 Nov 2023, in the session's time zone."""
    return F.regexp_replace(_utc(ms, "dd MMM yyyy"), " Sep ", " Sept ")


def date_time(ms: Column) -> Column:
    """14 Nov 2023, 22:13"""
    return F.regexp_replace(_utc(ms, "dd MMM yyyy, HH:mm"), " Sep ", " Sept ")


def duration(ms: Column) -> Column:
    """45 sec, 1.5 min, 12 min, 3.0 h, 2.5 days, 4 months"""
    s = half_up(ms / 1000)
    one = lambda v, unit: F.concat(F.when(v < 10, F.format_string("%.1f", v)).otherwise(half_up(v).cast("string")), F.lit(unit))
    m, h, d = s / 60.0, s / 3600.0, s / 86400.0
    shown = (
        F.when(s < 60, F.concat(s.cast("string"), F.lit(" sec")))
        .when(m < 60, one(m, " min"))
        .when(h < 24, one(h, " h"))
        .when(d < 60, one(d, " days"))
        .otherwise(F.concat(half_up(d / MONTH_DAYS).cast("string"), F.lit(" months")))
    )
    return F.coalesce(shown, F.lit(MISSING))
