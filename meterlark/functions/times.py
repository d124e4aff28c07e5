"""Time expressions and windows. The session time zone is UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_HOUR = 1800
DAY = 86400
MOST_POINTS = 1024
UTC = dt.timezone.utc
#: Date forms of usage exports, tried in order after ISO forms (fixed values).
EXPORT_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "MMM d, yyyy, h:mm a", "MMMM d, yyyy, h:mm a", "MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy H:mm", "M/d/yyyy")


def half_hour(at: Column) -> Column:
    """Down to :00 or :30."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(at) / HALF_HOUR) * HALF_HOUR)


def log_time(text: Column) -> Column:
    """RFC 3339, ISO without zone (UTC), or epoch seconds or milliseconds (told apart at 1e12); null if it is none."""
    number = text.try_cast("double")
    epoch = F.when(F.abs(number) < 1e12, (number * 1000).try_cast("bigint")).otherwise(number.try_cast("bigint"))
    return F.when(number.isNotNull(), F.timestamp_millis(epoch)).otherwise(F.try_to_timestamp(text))


def export_time(text: Column, zone: str = "UTC") -> Column:
    """A date cell of a usage export; one without zone is in ``zone``."""
    s = F.trim(text)
    zoned = F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(s))
    naive = F.coalesce(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(s)), *[F.try_to_timestamp(s, F.lit(form)) for form in EXPORT_FORMS])
    return F.coalesce(zoned, F.to_utc_timestamp(naive, zone))


def day_start(t: dt.datetime) -> dt.datetime:
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def next_day(t: dt.datetime) -> dt.datetime:
    """The first midnight that is not before ``t``."""
    start = day_start(t)
    return start if start == t else start + dt.timedelta(days=1)


def series_grid(start: dt.datetime, end: dt.datetime, most: int = MOST_POINTS) -> tuple[int, int, int]:
    """(step seconds, first bin's epoch second, number of bins): the finest clock-aligned grid with at most ``most`` bins."""
    first, last = int(start.timestamp() // 1), int((end - dt.timedelta(microseconds=1)).timestamp() // 1)
    if end <= start:
        return HALF_HOUR, first, 0
    steps = iter((HALF_HOUR, 3600, 7200, 10800, 21600))
    step = next(steps)
    while last // step - first // step + 1 > most:
        step = next(steps, step * 2)
    return step, first // step * step, last // step - first // step + 1


def next_tick(now: int, period: int) -> int:
    """The next multiple of ``period`` after ``now``."""
    return (now // period + 1) * period


def interval_seconds(text: str) -> int:
    """``90``, ``30s``, ``5m`` or ``2h`` as seconds, within 15 s and a day."""
    s = text.strip().lower()
    unit = {"s": 1, "m": 60, "h": 3600}.get(s[-1:], 0)
    value = int(s[:-1]) * unit if unit else int(s)
    if not 15 <= value <= DAY:
        raise ValueError(f"interval out of bounds: {text}")
    return value


def preset_window(name: str, now: dt.datetime, start: dt.datetime | None = None, end: dt.datetime | None = None) -> tuple[dt.datetime, dt.datetime]:
    """today, 24h, 7d, 30d, 90d or custom."""
    if name == "today":
        return day_start(now), now
    if name == "custom":
        if start is None or end is None:
            raise ValueError("a custom window needs both ends")
        return start, end
    return now - dt.timedelta(hours={"24h": 24, "7d": 168, "30d": 720, "90d": 2160}[name]), now


def since_time(text: Column) -> Column:
    """A date (its midnight in UTC) or a time with zone from which to count; null if it is neither."""
    s = F.trim(text)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(s)).when(s.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(s))


def first_of_month(day: dt.date, today: dt.date) -> dt.date:
    """The first day of a day's month; for a month to come, today."""
    return min(day.replace(day=1), today)


def covered_days(start: dt.date, end: dt.date) -> int:
    return (end - start).days + 1


def month_before(at: Column) -> Column:
    """The same time of day a month earlier, or on that month's last day."""
    return F.timestamp_seconds(F.unix_seconds(F.add_months(F.to_date(at), -1).cast("timestamp")) + F.pmod(F.unix_seconds(at), F.lit(DAY)))


def shifted_cell(weekday: Column, hour: Column, offset_hours: int) -> Column:
    """Cell number (weekday * 24 + hour) in a zone that is whole hours away."""
    return F.pmod(weekday * 24 + hour + F.lit(offset_hours), F.lit(168))
