"""The aggregator language: "type(#pattern) as Header#col+spec"."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PatternError
from ..plans.patterns import TOKEN, TagColumn, TagPattern
from . import normalize as nz
from .formulas import TEXT, Value, first_value

_SPEC = re.compile(rf"\s*(?P<type>{TOKEN})\s*(?:\(\s*(?P<pattern>[^)]*?)\s*\))?\s*(?:\bas\b\s*(?P<spec>.+?))?\s*", re.IGNORECASE)


def _count(frame, value: Value | None, date: bool) -> Value:
    return Value(F.count(F.lit(1)), T.LongType())


def _sum(frame, value: Value, date: bool) -> Value:
    n = nz.number(value.column, value.type)
    kind = T.LongType() if isinstance(value.type, T.IntegralType) else T.DoubleType()
    return Value(F.sum(n), kind)


def _average(frame, value: Value, date: bool) -> Value:
    return Value(F.avg(nz.number(value.column, value.type)), T.DoubleType())


def reversed_order(df, name: str) -> Column:
    """An order column turned round, if it is a number; of equal keys the first then comes last."""
    return -F.col(name) if isinstance(df.schema[name].dataType, T.NumericType) else F.lit(0)


def _extreme(least: bool):
    def run(frame, value: Value, date: bool) -> Value:
        """The raw value with the least or greatest typed key; of equals the first."""
        if nz.is_number_type(value.type) or nz.is_time_type(value.type):
            return Value((F.min if least else F.max)(value.column), value.type)
        key = nz.typed_key(value.column, value.type, date)
        some = ~nz.is_empty(value.column, value.type)
        if least:
            order = [F.col(c) for c, _ in frame.order]
            return Value(F.min_by(F.when(some, value.column), F.when(some, F.struct(key, *order))), value.type)
        back = [reversed_order(frame.df, c) for c, _ in frame.order]
        return Value(F.max_by(F.when(some, value.column), F.when(some, F.struct(key, *back))), value.type)

    return run


def _concat(frame, value: Value, date: bool) -> Value:
    text = nz.norm_space(value.column, value.type)
    return Value(F.array_join(F.sort_array(F.collect_set(F.nullif(text, F.lit("")))), "|"), TEXT)


#: type -> aggregate over (frame, first non-empty value of the pattern's columns, whether it is a date). Add types here.
AGGREGATORS: dict[str, Callable[..., Value]] = {
    "count": _count,
    "sum": _sum,
    "average": _average,
    "min": _extreme(True),
    "max": _extreme(False),
    "concat": _concat,
}


@dataclass(frozen=True)
class Aggregator:
    type: str
    pattern: TagPattern | None
    column: TagColumn

    @staticmethod
    def parse(spec: str | Aggregator) -> Aggregator:
        if isinstance(spec, Aggregator):
            return spec
        m = _SPEC.fullmatch(spec)
        kind = m and m["type"].lower()
        if not m or kind not in AGGREGATORS:
            raise PatternError(f"not an aggregator: {spec!r}")
        pattern = TagPattern.parse(m["pattern"]) if m["pattern"] else None
        if pattern is None and kind != "count":
            raise PatternError(f"{kind} needs a tag pattern: {spec!r}")
        column = TagColumn.parse(m["spec"]) if m["spec"] else TagColumn.parse(f"{kind}#meta+{kind}")
        return Aggregator(kind, pattern, column)

    @staticmethod
    def parse_list(specs) -> list[Aggregator]:
        if not specs:
            return [Aggregator.parse("count() as Count#meta+count")]
        if isinstance(specs, (str, Aggregator)):
            specs = re.split(r",(?![^(]*\))", specs) if isinstance(specs, str) else [specs]
        return [Aggregator.parse(s) for s in specs]

    def lower(self, frame) -> Column:
        if self.pattern is None or self.type == "count":
            return AGGREGATORS["count"](frame, None, False).column
        cells = frame.cells(self.pattern)
        if not cells:
            return F.max(F.lit(None).cast("string"))
        return AGGREGATORS[self.type](frame, first_value(cells), self.pattern.tag == "#date").column
