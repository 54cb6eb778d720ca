"""Time arithmetic on UTC epoch milliseconds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS


def event_time(source_ts: Column, received_ts: Column) -> Column:
    """The controller's timestamp, or the receive time when it sent none."""
    return F.coalesce(source_ts, received_ts)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def seconds_text(ms: Column) -> Column:
    """Second resolution, ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def utc_date(ms: Column) -> Column:
    """The storage partition of a reading."""
    return F.to_date(F.timestamp_millis(ms))


def window_start(ms: Column, size_ms: int) -> Column:
    """Windows are aligned to the UTC epoch."""
    return ms - F.pmod(ms, F.lit(size_ms))


def retention_cutoff(as_of_ms: int, days: int) -> int:
    return as_of_ms - days * DAY_MS


def ms_to_date(ms: int) -> dt.date:
    return dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc).date()


def ms_to_iso(ms: int) -> str:
    at = dt.datetime.fromtimestamp(ms // 1000, dt.timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{ms % 1000:03d}Z"


def last_elapsed_window(as_of_ms: int, size_ms: int) -> int:
    """Start of the newest window that has fully elapsed."""
    return as_of_ms // size_ms * size_ms - size_ms
