"""Times, durations and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 1601-01-01 to 1970-01-01.
EPOCH_1601 = 11_644_473_600_000_000
#: Seconds of the year 5000: a larger number of "seconds" counts microseconds.
YEAR_5000 = 95_617_584_000
MAX_ATTEMPTS, BASE_DELAY_S, MAX_DELAY_S = 5, 30, 3600
#: Layouts that stored times may have.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd HH:mm:ss")


def parsed(text: Column) -> Column:
    """A stored time in any of its layouts; null otherwise."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(x)) for x in LAYOUTS))


def formatted(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_1601_micros(text: Column) -> Column:
    """A time in microseconds since 1601; null for none, zero, and times before 1970."""
    v = text.try_cast("long")
    return F.when((v > 0) & (v >= EPOCH_1601), F.timestamp_micros(v - EPOCH_1601))


def from_micros(v: Column) -> Column:
    return F.when(v > 0, F.timestamp_micros(v))


def from_attribute(text: Column) -> Column:
    """A bookmark file's date: seconds, maybe with a fraction, or microseconds; null if not positive."""
    v = F.trim(text).try_cast("double")
    secs = F.when(v > YEAR_5000, v / 1_000_000).otherwise(v)
    return F.when(v > 0, F.timestamp_seconds(F.floor(secs)))


def millis_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1000.0)


def retry_delay(attempts: Column) -> Column:
    """Seconds until a failed job runs again, attempts being those so far: doubling, an hour at most."""
    return F.least(F.lit(MAX_DELAY_S), F.lit(BASE_DELAY_S) * F.pow(F.lit(2), F.least(attempts, F.lit(20)))).cast("int")


_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration_seconds(text: Column) -> Column:
    """Seconds of `Nd` (days) or of a sequence like 1h30m; null for anything else."""
    days = F.regexp_extract(text, r"^([0-9]+)d$", 1)
    part = r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)(ns|us|µs|ms|s|m|h)"
    numbers, units = F.regexp_extract_all(text, F.lit(part), F.lit(1)), F.regexp_extract_all(text, F.lit(part), F.lit(2))
    worth = F.create_map(*(x for k, v in _UNITS.items() for x in (F.lit(k), F.lit(v))))
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("double") * worth[u]), F.lit(0.0), lambda a, b: a + b)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(days != "", days.cast("double") * 86_400).when(text.rlike(rf"^[-+]?({part})+$"), sign * total).when(text.rlike("^[-+]?0$"), 0.0)


def clock(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s.cast("long"))).otherwise(F.format_string("%d:%02d", m, s.cast("long")))


def compact_date(text: Column) -> Column:
    """yyyymmdd as a date; null otherwise."""
    return F.when(F.length(text) == 8, F.try_to_date(text, "yyyyMMdd"))
