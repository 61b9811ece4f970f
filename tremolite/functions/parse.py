"""Cleaning of dirty feed fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"-?\d+(\.\d+)?"


def first_number(raw: Column) -> Column:
    """The first number after commas become points; null if there is none."""
    return F.regexp_extract(F.replace(raw, F.lit(","), F.lit(".")), NUMBER, 0).try_cast("double")


def coordinate(raw: Column, is_lat: bool) -> Column:
    """Signed degrees: a letter N, S, E or W anywhere gives the sign (S of a latitude, W of a longitude is negative)."""
    up = F.upper(raw)
    sign = F.when(up.contains("S" if is_lat else "W"), -1.0).when(up.rlike("[NSEW]"), 1.0)
    return F.when(sign.isNull(), first_number(raw)).otherwise(F.abs(first_number(raw)) * sign)


def met_datetime(date: Column, time: Column) -> Column:
    """Microseconds since 1970 of a date and a time of day (UTC, with or without seconds); no time is midnight; null if
    bad. The session's time zone has no part in it."""
    at = F.when((time == "") | time.isNull(), "0:0").otherwise(time)
    good = date.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$") & at.rlike(r"^[0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2})?$")
    d, t = F.split(date, "-"), F.split(at, ":")
    part = lambda parts, n: F.get(parts, F.lit(n)).try_cast("int")
    local = F.try_make_timestamp_ntz(part(d, 0), part(d, 1), part(d, 2), part(t, 0), part(t, 1), F.coalesce(part(t, 2), F.lit(0)).cast("decimal(8,6)"))
    return F.when(good, F.get(F.transform(F.array(local), micros), F.lit(0)))


def micros(local: Column) -> Column:
    """Microseconds since 1970 of a time without zone, taken as UTC. From its fields: Spark's difference of instants goes by
    the session's zone."""
    days = F.date_diff(local.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86_400 + F.hour(local) * 3600 + F.minute(local) * 60) * 1_000_000 + (F.date_part(F.lit("SECOND"), local) * 1_000_000).cast("long")
