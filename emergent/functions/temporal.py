"""Dates and timestamps in strings: the strict sniff that inference uses, and the same parse as Column expressions."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_PATTERN = r"^[0-9]{1,4}([-/ ])[0-9]{1,2}\1[0-9]{1,2}$"
TIME_PATTERN = r"^([0-9]{1,4}[-/ ][0-9]{1,2}[-/ ][0-9]{1,2})[T ]([0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?)?$"
_date, _time = re.compile(DATE_PATTERN), re.compile(TIME_PATTERN)


def parse_date(text: str) -> date | None:
    if not _date.match(text):
        return None
    try:
        return date(*map(int, re.split("[-/ ]", text)))
    except ValueError:
        return None


def parse_timestamp(text: str) -> datetime | None:
    """A timestamp without zone: a trailing Z or offset is dropped, fractions are cut to microseconds."""
    found = _time.match(text)
    day = parse_date(found[1]) if found else None
    if not day:
        return None
    clock = [*found[2].split(":"), "0"][:3]
    whole, _, fraction = clock[2].partition(".")
    try:
        return datetime(day.year, day.month, day.day, int(clock[0]), int(clock[1]), int(whole), int(fraction[:6].ljust(6, "0") or 0))
    except ValueError:
        return None


def sniff(text: str) -> str:
    """DATE, TIMESTAMP or VARCHAR."""
    if 8 <= len(text) <= 40 and text[0].isascii() and text[0].isdigit():
        if parse_date(text):
            return "DATE"
        if parse_timestamp(text):
            return "TIMESTAMP"
    return "VARCHAR"


def date_column(text: Column) -> Column:
    """parse_date as an expression."""
    return F.when(text.rlike(DATE_PATTERN), F.translate(text, "/ ", "--").try_cast("date"))


def timestamp_column(text: Column) -> Column:
    """parse_timestamp as an expression; a date is its midnight."""
    day = F.translate(F.regexp_extract(text, TIME_PATTERN, 1), "/ ", "--")
    clock = F.regexp_extract(text, TIME_PATTERN, 2)
    clock = F.when(clock.rlike("^[0-9]:"), F.concat(F.lit("0"), clock)).otherwise(clock)
    stamp = F.concat_ws(" ", day, F.regexp_replace(clock, r"(\.[0-9]{6})[0-9]+$", "$1")).try_cast("timestamp_ntz")
    return F.when(text.rlike(TIME_PATTERN), stamp).otherwise(date_column(text).cast("timestamp_ntz"))
