"""Dates in the many forms that people write, as ISO text: 2020, 2020-06, 2020-06-01, 2020Q2, 2020W07."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

import pandas as pd
from dateutil import parser
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import is_text, is_time_type

#: Year, quarter, week, month and day as ISO has them (quarters apart), and SQL's timestamps.
ISO = re.compile(r"([12]\d{3})(?:Q([1-4])|W(\d\d?)|-(\d\d?)(?:-(\d\d?))?)?", re.IGNORECASE)
SQL = re.compile(r"([12]\d{3})-(\d\d?)-(\d\d?) \d\d?:\d\d?:\d\d?")
#: Whole numbers from FIRST_DAY are days, and above FIRST_SECOND seconds, since 1970.
FIRST_DAY, FIRST_SECOND = 2200, 100_000
#: Two defaults that differ in all parts show which parts a text lacks: common years, long months, early days.
DEFAULTS = (datetime(2013, 7, 2), datetime(2018, 10, 5))
LONGEST_MONTHS = (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _written(year: int, month: int | None = None, day: int | None = None) -> str | None:
    if month is None:
        return f"{year:04d}"
    if not 1 <= month <= 12:
        return None
    if day is None:
        return f"{year:04d}-{month:02d}"
    return f"{year:04d}-{month:02d}-{day:02d}" if 1 <= day <= LONGEST_MONTHS[month - 1] else None


def parse_date(value: object, dayfirst: bool = True, now: datetime | None = None) -> str | None:
    """ISO text of a date, or None. Epoch numbers are in UTC; a month alone is of the current year."""
    if isinstance(value, datetime) or hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    text = " ".join(str("" if value is None else value).split())
    try:
        n = int(value) if not isinstance(value, float) or value == int(value) else None
        if n is not None and n > FIRST_SECOND:
            return datetime.fromtimestamp(n, UTC).strftime("%Y-%m-%d") if n < 253_402_300_800 else _from_millis(text)
        if n is not None and n >= FIRST_DAY:
            return (datetime(1970, 1, 1) + timedelta(days=n - 1)).strftime("%Y-%m-%d")
    except (TypeError, ValueError, OverflowError, OSError):
        pass
    if m := ISO.fullmatch(text):
        year, quarter, week, month, day = (int(x) if x else None for x in m.groups())
        if quarter:
            return f"{year:04d}Q{quarter}"
        if week is not None:
            return f"{year:04d}W{week:02d}" if 1 <= week <= 53 else None
        return _written(year, month, day)
    if m := SQL.fullmatch(text):
        return _written(*map(int, m.groups()))
    if not text or (text.isnumeric() and len(text) >= 10):
        return _from_millis(text)
    try:
        a, b = (parser.parse(text, default=d, dayfirst=dayfirst) for d in DEFAULTS)
    except (ValueError, OverflowError, TypeError, AttributeError):
        return None
    year, month, day = (x if x == y else None for x, y in ((a.year, b.year), (a.month, b.month), (a.day, b.day)))
    if month is None and (day is not None or year is None):
        return None
    return _written(year if year is not None else (now or datetime.now(UTC)).year, month, day)


def _from_millis(text: str) -> str | None:
    try:
        return datetime.fromtimestamp(int(text) / (1000 if len(text) >= 13 else 1), UTC).strftime("%Y-%m-%d")
    except (ValueError, OverflowError, OSError):
        return None


def _parser(dayfirst: bool):
    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        known = {v: parse_date(v, dayfirst) for v in values.unique()}
        return values.map(known)

    return run


def norm_date(c: Column, t: T.DataType, dayfirst: bool = True) -> Column:
    """The cell as ISO date text, or null. Native dates and times, and text that is a plain ISO date or SQL timestamp, need no Python; other text goes through one Arrow batch at a time, each different value once."""
    if is_time_type(t):
        return F.date_format(c, "yyyy-MM-dd")
    text = c.cast("string")
    day = F.substr(text, F.lit(1), F.lit(10))
    plain = text.rlike(r"^[12]\d{3}-\d\d-\d\d(?: \d\d:\d\d:\d\d)?$") & F.try_to_date(day).isNotNull()
    return F.when(plain, day).otherwise(_parser(dayfirst)(F.when(plain, F.lit(None)).otherwise(text)))
