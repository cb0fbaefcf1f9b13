"""Days, weekdays, zones and other text and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_weekday(time: Column) -> Column:
    """1 is Monday."""
    return F.weekday(time) + 1


def is_weekend(time: Column) -> Column:
    return iso_weekday(time) >= 6


def trading_date(time: Column, zone: str = "Europe/Paris") -> Column:
    """The local date, summer time included."""
    return F.to_date(F.from_utc_timestamp(time, zone))


def offset_date(time: Column, hours: int) -> Column:
    return F.to_date(time + F.make_dt_interval(F.lit(0), F.lit(hours)))


def day_code(time: Column) -> Column:
    return F.date_format(time, "yyyyMMdd")


def parse_day(text: Column) -> Column:
    """The date in the last eight digits of a text such as part=20240131."""
    return F.to_date(F.regexp_extract(F.regexp_replace(text, "[^0-9]", ""), r"(\d{8})$", 1), "yyyyMMdd")


def symbol_name(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def relative_path(path: Column, root: Column) -> Column:
    """A path below a root without it."""
    return F.when(F.startswith(path, root), F.regexp_replace(F.substr(path, F.length(root) + 1), "^/+", "")).otherwise(path)


def session_windows(text: Column) -> Column:
    """Session windows kept as JSON in a column."""
    return F.from_json(text, "array<struct<start:string,end:string>>")
