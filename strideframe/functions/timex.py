"""Clock text, calendar and duration expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Weekday labels, Sunday first.
WEEKDAYS = ("周日", "周一", "周二", "周三", "周四", "周五", "周六")


def clock_to_sec(c: Column) -> Column:
    """Seconds of ``HH:MM:SS``, ``MM:SS`` or a plain number; NULL when malformed."""
    p = F.split(F.trim(c), ":")
    n = F.size(p)

    def part(i: int) -> Column:
        return F.get(p, F.lit(i)).try_cast("double")

    return (
        F.when(n == 3, part(0) * 3600 + part(1) * 60 + part(2))
        .when(n == 2, part(0) * 60 + part(1))
        .when(n == 1, part(0))
    )


def sec_to_clock(c: Column) -> Column:
    """``HH:MM:SS`` of whole seconds."""
    s = F.floor(c).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def first_time(*fields: Column) -> Column:
    """First field that parses as seconds, else 0."""
    return F.coalesce(*[clock_to_sec(f.cast("string")) for f in fields], F.lit(0.0))


def week_start(day: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "month").cast("date"), F.last_day(day)


def minutes_between(start: Column, end: Column) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / 60e6 + 0.5)


def weekday_label(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAYS]), F.dayofweek(day))
