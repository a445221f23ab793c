"""Clocks: 100 ns ticks since 0001-01-01 as LONG. Timestamps hold microseconds, so a clock is kept and a timestamp derived."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TICKS_PER_SECOND = 10_000_000
TICKS_PER_DAY = 864_000_000_000
UNIX_EPOCH_TICKS = 621_355_968_000_000_000
MIN_CLOCK, MAX_CLOCK = 0, 3_155_378_975_999_999_999
#: Named retention periods in days.
RETENTION_DAYS = {"day": 1, "week": 7, "month": 31, "year": 366, "three_years": 1096, "ten_years": 3650, "hundred_years": 36500}


def clock_of(ts: Column | str) -> Column:
    """Clock of a timestamp, with or without zone; the session's time zone has to be UTC for the latter."""
    return F.lit(UNIX_EPOCH_TICKS) + F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) * 10


def timestamp_of(clock: str) -> Column:
    """Timestamp of a column of clocks; the last decimal digit is lost."""
    return F.expr(f"timestamp_micros((`{clock}` - {UNIX_EPOCH_TICKS}L) div 10)")


def point_text(clock: str, value: str) -> Column:
    """A point as text: its time to the millisecond and its value."""
    return F.concat_ws(" ", F.date_format(timestamp_of(clock), "yyyy-MM-dd HH:mm:ss.SSS"), F.col(value).cast("string"))


def clock_literal(day: str) -> int:
    """Clock of a day or time in ISO form (UTC)."""
    from datetime import UTC, datetime

    t = datetime.fromisoformat(day).replace(tzinfo=UTC)
    return UNIX_EPOCH_TICKS + (int(t.timestamp()) * 10**6 + t.microsecond) * 10
