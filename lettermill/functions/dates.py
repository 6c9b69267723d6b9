"""Calendar dates and times as columns and as plain values of requests."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
_DATE = re.compile(r"([+-]?\d+)-([+-]?\d+)-([+-]?\d+)", re.ASCII)


def parse_date_ms(value: str, strict: bool = False) -> int | None:
    """Milliseconds of a ``Y-M-D`` date; None if it isn't one.

    Days up to 31 are taken in every month and roll over into the next, unless ``strict``.
    """
    found = _DATE.fullmatch(value.strip())
    if not found:
        return None
    year, month, day = map(int, found.groups())
    if not (1 <= month <= 12 and 1 <= day <= 31 and 1 <= year <= 9999):
        return None
    date = dt.date(year, month, 1) + dt.timedelta(days=day - 1)
    if strict and date.month != month:
        return None
    return (date - dt.date(1970, 1, 1)).days * DAY_MS


def inclusive_day_end(value: str) -> int | None:
    """The exclusive bound, in milliseconds, that keeps the whole of the given last day."""
    start = parse_date_ms(value)
    return None if start is None else start + DAY_MS


def date_ms(value: Column) -> Column:
    """The same as ``parse_date_ms``, for a column of dates with years of up to four digits."""
    text = F.trim(value)
    part = lambda i: F.regexp_extract(text, r"^(\d{1,4})-(\d{1,2})-(\d{1,2})$", i)
    year, month, day = (F.when(part(i) != "", part(i).cast("int")) for i in (1, 2, 3))
    sound = month.between(1, 12) & day.between(1, 31) & (year >= 1)
    first = F.make_date(F.when(sound, year), F.when(sound, month), F.lit(1))
    return F.unix_date(F.date_add(first, day - 1)).cast("long") * DAY_MS


def format_ms(value: Column, unknown: str = "unknown") -> Column:
    """``YYYY-MM-DD HH:MM`` in UTC; times at or before the epoch, and nulls, are unknown."""
    return F.when(value > 0, F.date_format(F.timestamp_millis(value), "yyyy-MM-dd HH:mm")).otherwise(unknown)


def civil_date(days: Column) -> Column:
    """The date of a number of days since the epoch."""
    return F.date_from_unix_date(days.cast("int"))
