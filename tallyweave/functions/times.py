"""Time functions over columns. Clocks without a zone are TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(c: Column) -> Column:
    """A local clock from ISO forms with T or space, with or without seconds or fractions; the zone's part is cut."""
    bare = F.regexp_replace(F.trim(c), r"(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    bare = F.regexp_replace(bare, "T", " ")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS][.S]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]).cast("timestamp_ntz")


def offset_minutes(c: Column) -> Column:
    """Minutes of ``+07:00``, ``-3:30``, ``UTC+8``, ``Z``; null for blank, unreadable or impossible ones."""
    text = F.upper(F.trim(c))
    form = r"^(?:UTC|GMT)?\s*([+-])\s*([0-9]{1,2})(?::?([0-9]{2}))?$"
    hours, minutes = F.regexp_extract(text, form, 2).try_cast("int"), F.coalesce(F.regexp_extract(text, form, 3).try_cast("int"), F.lit(0))
    total = F.when((hours <= 14) & (minutes <= 59), hours * 60 + minutes)
    return F.when(text.isin("UTC", "GMT", "Z"), 0).when(F.regexp_extract(text, form, 1) == "-", -total).otherwise(total)


def zone_minutes(c: Column) -> Column:
    """As offset_minutes, besides ``Etc/GMT+N``, whose sign is the other way round."""
    name = F.upper(F.trim(c))
    hours = F.regexp_extract(name, r"^ETC/GMT([+-])([0-9]{1,2})$", 2).try_cast("int") * 60
    return F.when(name.isin("ETC/UTC", "ETC/GMT"), 0).when(name.startswith("ETC/GMT+"), -hours).when(name.startswith("ETC/GMT-"), hours).otherwise(offset_minutes(c))


def offset_text(minutes: Column) -> Column:
    """``+07:00``; null gives an empty text."""
    m = F.abs(minutes)
    text = F.concat(F.when(minutes < 0, "-").otherwise("+"), F.lpad(F.floor(m / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"))
    return F.coalesce(text, F.lit(""))


def zone_name(minutes: Column) -> Column:
    return F.when(minutes == 0, "UTC").otherwise(F.when(minutes.isNotNull(), F.concat(F.lit("UTC"), offset_text(minutes))))


def utc_of(c: Column) -> Column:
    """The UTC instant of a text with an offset other than zero; null otherwise, as Z says nothing about a log's zone."""
    minutes = offset_minutes(F.regexp_extract(F.trim(c), r"([+-][0-9]{2}:?[0-9]{2})$", 1))
    return F.when(minutes != 0, parsed(c) - F.make_dt_interval(mins=minutes))


def clock(seconds: Column) -> Column:
    """``46:20``, from an hour on ``1:02:03``."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    s = seconds.cast("long")
    minutes = F.floor(s / 60)
    return F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(minutes % 60), F.lit(":"), two(s % 60))).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(s % 60)))


def duration_s(c: Column) -> Column:
    """Seconds of ``46:20``, or of minutes alone; 0 where there is no number."""
    form = r"^\s*([0-9]+)(?::([0-9]+))?"
    return F.coalesce(F.regexp_extract(c, form, 1).try_cast("int") * 60, F.lit(0)) + F.coalesce(F.regexp_extract(c, form, 2).try_cast("int"), F.lit(0))


def whole_minutes(seconds: Column) -> Column:
    return F.rint(seconds / 60).cast("int")


def epoch_1989(seconds: Column) -> Column:
    """A device's seconds since 1989-12-31 as a UTC clock."""
    return F.timestamp_seconds(seconds + 631_065_600).cast("timestamp_ntz")


def semicircles(c: Column) -> Column:
    return c * (180.0 / 2**31)


def candidate_dates(local: Column, utc: Column) -> Column:
    """The dates of both clocks and a day around."""
    dates = lambda t: F.when(t.isNotNull(), F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.date_add(t.cast("date"), d)))
    empty = F.array().cast("array<date>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(dates(local), empty), F.coalesce(dates(utc), empty))))


def next_daily(now: Column, hour: Column, minute: Column) -> Column:
    day = F.date_trunc("DAY", now).cast("timestamp_ntz") + F.make_dt_interval(hours=hour, mins=minute)
    return F.when(day <= now, day + F.make_dt_interval(days=F.lit(1))).otherwise(day)


def next_weekly(now: Column, weekday: Column, hour: Column, minute: Column) -> Column:
    """``weekday`` counts from 0, a Sunday."""
    ahead = F.pmod(weekday - (F.dayofweek(now) - 1), F.lit(7))
    day = F.date_trunc("DAY", now).cast("timestamp_ntz") + F.make_dt_interval(days=ahead, hours=hour, mins=minute)
    return F.when(day <= now, day + F.make_dt_interval(days=F.lit(7))).otherwise(day)


def start_of_directory(c: Column) -> Column:
    """The start in a directory name such as ``2024/06/29-Sat-12=52=59``."""
    form = r"([0-9]{4})/([0-9]{2})/([0-9]{2})-[A-Z][a-z]{2}-([0-9]{2})=([0-9]{2})=([0-9]{2})"
    part = lambda i: F.regexp_extract(c, form, i).try_cast("int")
    return F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(8,6)"))
