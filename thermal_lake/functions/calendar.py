"""Dates and times as column expressions; sessions are in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def season(ts: Column) -> Column:
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def iso_week(ts: Column) -> Column:
    """The ISO year and week, like 2025-W01."""
    return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), ts), F.weekofyear(ts))


def local_hour(ts: Column, lon: Column) -> Column:
    """The UTC hour, without its minutes, plus a fifteenth of the longitude: floor-modulo 24, cut to a whole number."""
    return F.pmod(F.hour(ts) + lon / 15, F.lit(24.0)).cast("int")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def hour_prefixes(ts: Column, offset_seconds: int) -> Column:
    """Starts of all hours that the time, give or take the offset, touches."""
    step = F.expr(f"interval {offset_seconds} seconds")
    return F.sequence(F.date_trunc("hour", ts - step), F.date_trunc("hour", ts + step), F.expr("interval 1 hour"))


def day_of_year_stamp(text: Column) -> Column:
    """YYYYJJJHHMMSSt (t: tenths) as a timestamp; NULL if it isn't one."""
    whole = F.try_to_timestamp(F.when(text.rlike(r"^\d{14}$"), F.substring(text, 1, 13)), F.lit("yyyyDDDHHmmss"))
    return F.timestamp_micros(F.unix_micros(whole) + F.substring(text, 14, 1).try_cast("int") * 100_000)


def seconds_between(a: Column, b: Column) -> Column:
    """|a - b| in microseconds."""
    return F.abs(F.unix_micros(a) - F.unix_micros(b))


def micros_to_interval(moment: Column, start: Column, end: Column) -> Column:
    """Microseconds from a moment to an interval, 0 inside it."""
    return F.when((moment >= start) & (moment <= end), F.lit(0)).otherwise(F.least(seconds_between(moment, start), seconds_between(moment, end)))
