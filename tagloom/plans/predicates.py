"""The row-predicate language: "#pattern op value", lowered to a boolean Column."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PatternError
from ..functions import normalize as nz
from ..functions.dates import norm_date, parse_date
from ..functions.formulas import Value, compile_formula, sole_formula
from .patterns import TagPattern

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
CONDITIONS = ("empty", "number", "date", "min", "max")
_SPLIT = re.compile(r"([<>]=?|!?=|!?~|\bis\b)")


@dataclass(frozen=True)
class RowQuery:
    """One test: a row passes if any cell of the columns that match the pattern does."""

    pattern: TagPattern
    op: str
    value: str

    @staticmethod
    def parse(query: str | RowQuery) -> RowQuery:
        """Read a query. Its whole text is normalised first, so values and regular expressions are in lower case."""
        if isinstance(query, RowQuery):
            return query
        parts = _SPLIT.split(nz.python_norm_string(query), maxsplit=1)
        if len(parts) != 3:
            raise PatternError(f"no operator in query {query!r}")
        pattern, op, value = TagPattern.parse(parts[0]), parts[1], parts[2].strip()
        if op == "is" and value.removeprefix("not ") not in CONDITIONS:
            raise PatternError(f"unknown condition in query {query!r}")
        return RowQuery(pattern, op, value)

    def lower(self, frame) -> Column:
        """Condition over a frame's row; it may be null where a native cell is."""
        cells = frame.cells(self.pattern)
        if not cells:
            return F.lit(False)
        if self.op == "is":
            return _any(self._condition(frame, cells))
        if formula := sole_formula(self.value):
            other = compile_formula(formula, frame.cells)
            return _any(self._against(c, other) for c in cells)
        return _any(self.test_cell(frame, c) for c in cells)

    @property
    def _dated(self) -> bool:
        return self.pattern.tag == "#date"

    def _condition(self, frame, cells: list[Value]) -> list[Column]:
        negated, name = self.value.startswith("not "), self.value.removeprefix("not ")
        if name in ("min", "max"):
            return [_flip(t, negated) for t in extreme_tests(frame, self.pattern, name)]
        test = {"empty": lambda c: nz.is_empty(c.column, c.type), "number": lambda c: nz.is_number(c.column, c.type), "date": _is_date}[name]
        return [_flip(test(c), negated) for c in cells]

    def test_cell(self, frame, cell: Value) -> Column:
        """One cell against the query's literal value."""
        c, t = cell.column, cell.type
        day = parse_date(self.value) if self._dated else None
        if "~" in self.op:
            nz.check_regex(frame.df.sparkSession, self.value)
            text = nz.norm_string(c, t)
            if day is not None:
                text = F.coalesce(norm_date(c, t), text)
            return _flip(text.rlike(nz.java_regex(self.value)), self.op == "!~")
        compare, n = COMPARE[self.op], nz.python_number(self.value)
        if day is not None and nz.is_time_type(t):
            return _time_compare(c, self.op, day)
        if day is None and n is not None and nz.is_number_type(t):
            return compare(c, F.lit(n))  # on the native column, so that it reaches the scan
        out = compare(nz.norm_string(c, t), F.lit(self.value))
        if n is not None:
            x = nz.number(c, t)
            out = F.when(x.isNotNull(), compare(x, F.lit(float(n)))).otherwise(out)
        if day is not None:
            d = norm_date(c, t)
            out = F.when(d.isNotNull(), compare(d, F.lit(day))).otherwise(out)
        return out

    def _against(self, cell: Value, other: Value) -> Column:
        """Cell against a value of the same row; which kind of comparison is open is settled row by row."""
        c, t = cell.column, cell.type
        if "~" in self.op:
            return _flip(F.regexp_like(nz.norm_string(c, t), nz.norm_string(other.text(), nz.T.StringType())), self.op == "!~")
        compare = COMPARE[self.op]
        if nz.is_number_type(t) and nz.is_number_type(other.type):
            return compare(c, other.column)
        x, y = cell.maybe_number(), other.maybe_number()
        text = compare(nz.norm_string(c, t), nz.norm_string(other.text(), nz.T.StringType()))
        out = F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).otherwise(text)
        if self._dated:
            a, b = norm_date(c, t), norm_date(other.column, other.type)
            out = F.when(a.isNotNull() & b.isNotNull(), compare(a, b)).otherwise(out)
        return out


def _any(tests: Iterable[Column]) -> Column:
    return reduce(operator.or_, tests)


def _flip(test: Column, negated: bool) -> Column:
    return ~test if negated else test


def _is_date(cell: Value) -> Column:
    if nz.is_time_type(cell.type):
        return cell.column.isNotNull()
    return norm_date(cell.column, cell.type).isNotNull()


def _time_compare(c: Column, op: str, day: str) -> Column:
    """A native time against an ISO date, as a range of times that Parquet can skip by; partial dates as text."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        return COMPARE[op](F.date_format(c, "yyyy-MM-dd"), F.lit(day))
    start = date.fromisoformat(day)
    low, high = F.lit(start).cast("timestamp"), F.lit(start + timedelta(days=1)).cast("timestamp")
    return {"=": (c >= low) & (c < high), "!=": (c < low) | (c >= high), "<": c < low, "<=": c < high, ">": c >= high, ">=": c >= low}[op]


def extreme_tests(frame, pattern: TagPattern, name: str) -> list[Column]:
    """For each matching cell whether it equals the extreme of all of them; the extreme is a scalar subquery."""
    cells = frame.cells(pattern)
    pick = F.min if name == "min" else F.max
    if all(nz.is_number_type(c.type) for c in cells):
        row = (F.least if name == "min" else F.greatest)(*(c.column for c in cells)) if len(cells) > 1 else cells[0].column
        found = frame.df.agg(pick(row)).scalar()
        return [c.column == found for c in cells]
    keys = [F.when(~nz.is_empty(c.column, c.type), nz.typed_key(c.column, c.type, pattern.tag == "#date")) for c in cells]
    found = frame.df.select(F.explode(F.array(*keys)).alias("k")).where("k is not null").agg(pick("k")).scalar()
    return [F.coalesce(k == found, F.lit(False)) for k in keys]


def queries_of(queries) -> list[RowQuery]:
    if not queries:
        return []
    return [RowQuery.parse(q) for q in ([queries] if isinstance(queries, (str, RowQuery)) else queries)]


def any_query(frame, queries) -> Column | None:
    """Whether a row passes one of the queries; None, which means yes, if there are none."""
    parsed = queries_of(queries)
    return _any(q.lower(frame) for q in parsed) if parsed else None


def surely(test: Column | None) -> Column:
    """A test that is never null, for masks and negations."""
    return F.lit(True) if test is None else F.coalesce(test, F.lit(False))
