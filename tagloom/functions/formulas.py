"""The row-formula language, compiled to Column expressions.

    expr := NUMBER | "text" | #tag+pattern | (expr) | -expr | expr (+ - * / %) expr | name(expr, ...)

A small precedence-climbing parser makes a tree of tuples; compile_formula() lowers it once for a frame's columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PatternError
from ..plans.patterns import TOKEN, TagPattern
from . import normalize as nz
from .dates import norm_date

#: Fixed value: what stands for a formula that cannot be read.
ERROR = "**ERROR**"
_LEXER = re.compile(
    rf"""\s*(?:(?P<float>\d*\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)|(?P<text>"(?:[^"\\]|\\.)*")
    |(?P<tag>\#{TOKEN}(?:\s*[+-]{TOKEN})*!?)|(?P<name>{TOKEN})|(?P<mark>[()+\-*/%,]))""",
    re.VERBOSE,
)
_POWER = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2}
NUMBER, FLOAT, TEXT = T.DoubleType(), T.FloatType(), T.StringType()


def parse(formula: str) -> tuple:
    """Tree of a formula: ("const", value), ("tag", TagPattern), ("call", name, args) or (operator, left, right)."""
    tokens, at = [], 0
    formula = formula.strip()
    while at < len(formula):
        m = _LEXER.match(formula, at)
        if not m:
            raise PatternError(f"cannot read formula at {formula[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    tree, rest = _expression(tokens, 0, 0)
    if tokens[rest][0] != "end":
        raise PatternError(f"unexpected {tokens[rest][1]!r} in formula {formula!r}")
    return tree


def _expression(tokens: list, at: int, least: int) -> tuple[tuple, int]:
    left, at = _operand(tokens, at)
    while tokens[at][1] in _POWER and tokens[at][0] == "mark" and _POWER[tokens[at][1]] > least:
        sign = tokens[at][1]
        right, at = _expression(tokens, at + 1, _POWER[sign])
        left = (sign, left, right)
    return left, at


def _operand(tokens: list, at: int) -> tuple[tuple, int]:
    kind, text = tokens[at]
    if kind == "int":
        return ("const", int(text)), at + 1
    if kind == "float":
        return ("const", float(text)), at + 1
    if kind == "text":
        return ("const", json.loads(text)), at + 1
    if kind == "tag":
        return ("tag", TagPattern.parse(text)), at + 1
    if kind == "name" and tokens[at + 1][1] == "(":
        args, at = [], at + 2
        while tokens[at][1] != ")":
            arg, at = _expression(tokens, at, 0)
            args.append(arg)
            if tokens[at][1] == ",":
                at += 1
            elif tokens[at][1] != ")":
                raise PatternError(f"expected , or ) before {tokens[at][1]!r}")
        return ("call", text, tuple(args)), at + 1
    if text == "(":
        inner, at = _expression(tokens, at + 1, 0)
        if tokens[at][1] != ")":
            raise PatternError("a bracket is not closed")
        return inner, at + 1
    if text == "-" and kind == "mark":
        inner, at = _operand(tokens, at + 1)
        return ("-", ("const", 0), inner), at
    raise PatternError(f"unexpected {text or 'end'!r} in formula")


@dataclass(frozen=True)
class Value:
    """A compiled value: its column and type. A FloatType marks the result of a division, which shows its point and is NaN where it is null."""

    column: Column
    type: T.DataType

    def text(self) -> Column:
        if self.type == FLOAT:
            x = self.column
            whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
            return F.when(x.isNull(), "NaN").when(whole, F.concat(nz.render_number(x), F.lit(".0"))).otherwise(nz.render_number(x))
        return nz.as_text(self.column, self.type)

    def number(self) -> Column:
        """The value as a number, 0 if it is none."""
        c = self.column if self.type == FLOAT else nz.number(self.column, self.type)
        return F.coalesce(c.cast("double"), F.lit(0.0))

    def maybe_number(self) -> Column:
        return (self.column if self.type == FLOAT else nz.number(self.column, self.type)).cast("double")


Cells = Callable[[TagPattern], Sequence[Value]]


def first_value(values: Sequence[Value]) -> Value:
    """The first of several cells that is not the empty string; text unless all cells are of one type."""
    if not values:
        return Value(F.lit("None"), TEXT)
    kinds = {str(v.type) for v in values}
    if len(kinds) == 1:
        return Value(F.coalesce(*(nz.truthy(v.column, v.type) for v in values)), values[0].type)
    return Value(F.coalesce(*(F.nullif(v.text(), F.lit("")) for v in values), F.lit("")), TEXT)


def _sum(args: list[Value]) -> Value:
    total = F.lit(0.0)
    for a in args:
        total = total + a.number()
    return Value(total, NUMBER)


def _product(args: list[Value]) -> Value:
    total = F.lit(0.0) if not args else args[0].number()
    for a in args[1:]:
        total = total * a.number()
    return Value(total, NUMBER)


def _extreme(least: bool):
    def run(args: list[Value]) -> Value:
        pick = F.array_min if least else F.array_max
        if not args:
            return Value(F.lit(""), TEXT)
        if all(nz.is_number_type(a.type) for a in args):
            if len({str(a.type) for a in args}) == 1:
                return Value(pick(F.array(*(a.column for a in args))), args[0].type)
            return Value(pick(F.array(*(a.maybe_number() for a in args))), NUMBER)
        empty = [nz.is_empty(a.column, a.type) for a in args]
        numbers = [F.when(e, None).otherwise(a.maybe_number()) for a, e in zip(args, empty, strict=True)]
        all_numbers = F.lit(True)
        for e, n in zip(empty, numbers, strict=True):
            all_numbers = all_numbers & (e | n.isNotNull())
        texts = F.array_compact(F.array(*(F.when(~e, F.struct(nz.norm_string(a.column, a.type).alias("n"), a.text().alias("t"))) for a, e in zip(args, empty, strict=True))))
        return Value(F.coalesce(F.when(all_numbers, nz.render_number(pick(F.array(*numbers)))).otherwise(pick(texts)["t"]), F.lit("")), TEXT)

    return run


def _average(args: list[Value]) -> Value:
    numbers = F.array_compact(F.array(*(a.maybe_number() for a in args)))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    return Value(F.when(F.size(numbers) > 0, Value(total / F.size(numbers), FLOAT).text()).otherwise(""), TEXT)


def _round(args: list[Value]) -> Value:
    if not args or not nz.is_number_type(args[0].type):
        return args[0] if args else Value(F.lit(""), TEXT)
    return Value(F.bround(args[0].column.cast("double"), 0).cast("long"), T.LongType())


def _join(args: list[Value]) -> Value:
    return Value(F.concat_ws("", *_interleaved([a.text() for a in args[1:]], args[0].text())) if len(args) > 1 else F.lit(""), TEXT)


def _interleaved(parts: list[Column], mark: Column) -> list[Column]:
    return [c for p in parts for c in (mark, p)][1:]


def _today(args: list[Value]) -> Value:
    return Value(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd"), TEXT)


def _datedif(args: list[Value]) -> Value:
    """Days, weeks, months or years between two full dates; empty if there are none."""
    if len(args) not in (2, 3):
        return Value(F.lit(""), TEXT)

    def day(a: Value) -> Column:
        if nz.is_time_type(a.type):
            return F.to_date(a.column)
        text = norm_date(a.column, a.type)
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))

    days = F.datediff(day(args[1]), day(args[0]))
    if len(args) == 2:
        return Value(F.abs(days).cast("long"), T.LongType())
    unit = F.upper(args[2].text())
    return Value(
        F.when(unit == "D", F.abs(days)).when(unit == "W", F.abs(F.bround(days / 7, 0))).when(unit == "M", F.abs(F.bround(days / 30, 0))).when(unit == "Y", F.floor(F.abs(days / 365))).cast("long"),
        T.LongType(),
    )


def _case(change):
    return lambda args: Value(change(args[0].text()) if args else F.lit(""), TEXT)


#: name -> (function of compiled arguments, whether a pattern stands for all cells it matches). Add functions here.
FUNCTIONS: dict[str, tuple[Callable[[list[Value]], Value], bool]] = {
    "sum": (_sum, True),
    "product": (_product, True),
    "min": (_extreme(True), True),
    "max": (_extreme(False), True),
    "average": (_average, True),
    "round": (_round, False),
    "join": (_join, True),
    "today": (_today, False),
    "datedif": (_datedif, False),
    "toupper": (_case(F.upper), False),
    "tolower": (_case(F.lower), False),
}


def _const(value: object) -> Value:
    if isinstance(value, str):
        return Value(F.lit(value), TEXT)
    return Value(F.lit(float(value)), NUMBER)


def _lower(tree: tuple, cells: Cells) -> Value:
    kind = tree[0]
    if kind == "const":
        return _const(tree[1])
    if kind == "tag":
        return first_value(cells(tree[1]))
    if kind == "call":
        if tree[1] not in FUNCTIONS:
            return Value(F.lit(""), TEXT)
        function, every = FUNCTIONS[tree[1]]
        args: list[Value] = []
        for arg in tree[2]:
            args += cells(arg[1]) if every and arg[0] == "tag" else [_lower(arg, cells)]
        return function(args)
    a, b = _lower(tree[1], cells).number(), _lower(tree[2], cells).number()
    if kind == "/":
        return Value(F.when(b != 0, a / b), FLOAT)
    if kind == "%":
        return Value(F.when(b == 0, a).otherwise(a - b * F.floor(a / F.when(b == 0, 1.0).otherwise(b))), NUMBER)
    return Value({"+": a + b, "-": a - b, "*": a * b}[kind], NUMBER)


def compile_formula(formula: str, cells: Cells) -> Value:
    """A formula as a value over a frame's cells; one that cannot be read is the text ERROR."""
    try:
        tree = parse(formula)
    except PatternError:
        return Value(F.lit(ERROR), TEXT)
    return _lower(tree, cells)


def compile_template(text: str, cells: Cells) -> Column:
    """Text in which each {{formula}} is replaced by its value."""
    parts = re.split(r"\{\{(.+?)\}\}", text)
    pieces = [compile_formula(p, cells).text() if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*pieces) if len(pieces) > 1 else pieces[0] if pieces else F.lit("")


def sole_formula(text: str) -> str | None:
    m = re.fullmatch(r"\s*\{\{((?:(?!\}\}).)+)\}\}\s*", text)
    return m[1] if m else None
