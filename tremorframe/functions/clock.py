"""Time helpers.

The engine keeps event time as ``BIGINT`` microseconds since 1970 in UTC, so
window edges compare as integers and no result depends on the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
SECOND_US = 1_000_000


def _epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def ntz_micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp that holds UTC wall-clock time."""
    return F.timestamp_diff("MICROSECOND", _epoch(), ts)


def column_micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp column, whichever timestamp type it has."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return ntz_micros(F.col(name))
    return F.unix_micros(F.col(name))


def utc_timestamp(t_us: Column) -> Column:
    """Zone-less UTC timestamp of a microsecond column."""
    return F.timestamp_add("MICROSECOND", t_us, _epoch())


def format_utc(t_us: Column, pattern: str) -> Column:
    return F.date_format(utc_timestamp(t_us), pattern)


def eq_stamp(t_us: Column) -> Column:
    """14-digit sequence id: UTC time cut to the second."""
    return format_utc(t_us, "yyyyMMddHHmmss")


def hour_stamp(t_us: Column) -> Column:
    return format_utc(t_us, "yyyyMMddHH")


def parse_iso_micros(text: Column) -> Column:
    """Microseconds of ISO text with a zone (``Z`` or an offset); null if malformed.

    Text without a zone is taken as UTC.
    """
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(
        zoned, F.unix_micros(text.try_cast("timestamp"))
    ).otherwise(ntz_micros(text.try_cast("timestamp_ntz")))


def parse_date_time_micros(date: Column, time: Column) -> Column:
    """Microseconds of separate UTC date and time texts; ``/`` dates allowed."""
    text = F.concat_ws(" ", F.translate(F.trim(date), "/", "-"), F.trim(time))
    return F.when(
        date.isNotNull() & time.isNotNull(), ntz_micros(text.try_cast("timestamp_ntz"))
    )


def hours_between(t_us: Column, t0_us: Column, precision: str = "micro") -> Column:
    """Hours from ``t0_us`` to ``t_us``; ``precision='second'`` cuts both to seconds."""
    if precision == "micro":
        return (t_us - t0_us) / F.lit(float(HOUR_US))
    if precision == "second":
        whole = lambda t: F.floor(t / F.lit(float(SECOND_US)))
        return (whole(t_us) - whole(t0_us)) / F.lit(3600.0)
    raise ValueError(f"unknown precision {precision!r}")


def days_between(t_us: Column, t0_us: Column) -> Column:
    return (t_us - t0_us) / F.lit(float(DAY_US))
