"""Latitudes, longitudes and coordinates in degrees, minutes and seconds."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks after degrees, minutes and seconds, and what may stand between them.
_NUMBER = r"(\d+(?:\.\d*)?)"
_DEG, _MIN, _SEC, _GAP = rf"{_NUMBER}\s*°?", rf"{_NUMBER}\s*['`′]?", rf"{_NUMBER}\s*(?:[\"“”″]|['`′]{{2}})?", r"[\s:;,-]*"
_FINER = rf"(?:{_GAP}{_MIN}(?:{_GAP}{_SEC})?)"


def _layouts(hemispheres: str) -> tuple[re.Pattern, ...]:
    """A sign or a hemisphere in front, a hemisphere after the degrees, or one at the end; four groups: mark, degrees, minutes, seconds."""
    h = f"[{hemispheres}]"
    return (
        re.compile(rf"(?P<m>[+-])?\s*{_DEG}{_FINER}?", re.I),
        re.compile(rf"(?P<m>{h})\s*{_DEG}{_FINER}?", re.I),
        re.compile(rf"{_DEG}\s*(?P<m>{h})\s*{_FINER}?", re.I),
        re.compile(rf"{_DEG}{_FINER}\s*(?P<m>{h})?", re.I),
        re.compile(rf"{_DEG}\s*(?P<m>{h})?", re.I),
    )


_LAT, _LON = _layouts("NS"), _layouts("EW")


def _degrees(text: str, layouts: tuple[re.Pattern, ...], most: float) -> float | None:
    text = " ".join(str(text).split())
    for layout in layouts:
        if m := layout.fullmatch(text):
            mark = (m["m"] or "").upper()
            deg, minutes, seconds = _parts(m)
            if deg > most or minutes >= 60 or seconds >= 60:
                raise ValueError(f"out of range: {text!r}")
            value = deg + minutes / 60 + seconds / 3600
            return -value if mark in ("-", "S", "W") else value
    return None


def _parts(m: re.Match) -> tuple[float, float, float]:
    own = m.re.groupindex["m"]
    found = [float(m[i]) if m[i] else 0.0 for i in range(1, m.re.groups + 1) if i != own]
    return tuple((found + [0.0, 0.0])[:3])


def parse_lat(value: object) -> float | None:
    """Decimal degrees, None if it is no latitude; ValueError if out of range."""
    return _degrees(value, _LAT, 90)


def parse_lon(value: object) -> float | None:
    return _degrees(value, _LON, 180)


def parse_coord(value: object) -> tuple[float, float] | None:
    """(lat, lon) of two parts joined by one of / , : ; or a blank. A part that is zero does not count."""
    text = str(value)
    for mark in "/,:; ":
        parts = text.split(mark)
        if text.find(mark) > 0 and len(parts) == 2:
            lat, lon = parse_lat(parts[0]), parse_lon(parts[1])
            if lat and lon:
                return lat, lon
    return None


def _clean(kind: str, strict: bool):
    read = {"lat": lambda v: _format(parse_lat(v)), "lon": lambda v: _format(parse_lon(v)), "coord": lambda v: (lambda p: None if p is None else f"{p[0]:0.4f},{p[1]:0.4f}")(parse_coord(v))}[kind]

    def one(value: object) -> str | None:
        try:
            return read(value) if value else None
        except ValueError:
            if strict:
                raise
            return None

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        known = {v: one(v) for v in values.unique()}
        return values.map(known)

    return run


def _format(x: float | None) -> str | None:
    return None if x is None else f"{x:0.4f}"


def clean_place(text: Column, kind: str, strict: bool = False) -> Column:
    """Text of a latitude, longitude or coordinate with four decimals; null if it is none (or out of range, unless strict)."""
    return _clean(kind, strict)(text)
