"""Clock and calendar expressions: day serials, clock strings, reference times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col_of

# Origin and valid range of spreadsheet day serials, accepted
# reference-time layouts, and the years a recording may plausibly carry.
SERIAL_ORIGIN = "1899-12-30"
SERIAL_MIN, SERIAL_MAX = 1.0, 2958465.0
REFERENCE_FORMATS = [
    "M/d/yy H:mm",
    "M/d/yyyy H:mm",
    "M/d/yy H:mm:ss",
    "yyyy-MM-dd H:mm:ss",
    "yyyy-MM-dd H:mm",
    "M/d/yyyy H:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
]
PLAUSIBLE_YEARS = (2000, 2040)


def ntz(c: str | Column) -> Column:
    return col_of(c).cast("timestamp_ntz")


def micros_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", col_of(start), col_of(end))


def hours_between(start: str | Column, end: str | Column) -> Column:
    return micros_between(start, end) / F.lit(3.6e9)


def add_seconds(ts: str | Column, seconds: Column) -> Column:
    """Shift a timestamp by a fractional number of seconds, kept to the microsecond."""
    return F.timestamp_add("MICROSECOND", F.round(seconds * F.lit(1e6)).cast("bigint"), col_of(ts))


def serial_to_timestamp(serial: str | Column) -> Column:
    """Day serial to timestamp; out-of-range or non-numeric input gives null."""
    s = col_of(serial).try_cast("double")
    origin = F.lit(SERIAL_ORIGIN).cast("timestamp_ntz")
    return F.when(s.between(SERIAL_MIN, SERIAL_MAX), add_seconds(origin, s * F.lit(86400.0)))


def timestamp_to_serial(ts: str | Column) -> Column:
    return micros_between(F.lit(SERIAL_ORIGIN).cast("timestamp_ntz"), ts) / F.lit(86400e6)


_CLOCK = r"^\s*(\d+):(\d+)(?::(\d+(?:\.\d*)?))?\s*([AaPp][Mm])?\s*$"


def clock_seconds(text: str | Column) -> Column:
    """``H:MM[:SS[.f]] [AM|PM]`` to seconds of the day; null when it does not parse."""
    t = col_of(text)
    part = lambda i: F.regexp_extract(t, _CLOCK, i)
    hour = part(1).try_cast("int")
    mark = F.upper(part(4))
    hour24 = (
        F.when((mark == "PM") & (hour < 12), hour + 12)
        .when((mark == "AM") & (hour == 12), F.lit(0))
        .otherwise(hour)
    )
    sec = F.when(part(3) == "", F.lit(0.0)).otherwise(part(3).try_cast("double"))
    value = hour24 * 3600.0 + part(2).try_cast("int") * 60.0 + sec
    return F.when(F.rlike(t, F.lit(_CLOCK)), value)


def parse_reference_time(text: str | Column) -> Column:
    """A day serial, or one of the accepted layouts; anything else gives null."""
    t = F.trim(col_of(text).cast("string"))
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in REFERENCE_FORMATS]
    iso = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"))
    return F.coalesce(serial_to_timestamp(t), *tries, iso)


def implausible_year(ts: str | Column) -> Column:
    """True when the year lies outside the plausible range (shifted dates); false for null."""
    return F.coalesce(~F.year(col_of(ts)).between(*PLAUSIBLE_YEARS), F.lit(False))
