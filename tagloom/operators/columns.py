"""Operators on columns: keep, drop, add, rename."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from ..errors import PatternError
from ..frame import TagFrame
from ..functions import normalize as nz
from ..functions.formulas import compile_formula, compile_template, sole_formula
from ..plans.patterns import TOKEN, TagColumn, TagPattern

_RENAME = re.compile(rf"\s*(?P<header>[^#:]*?)(?P<pattern>#\s*{TOKEN}(?:\s*[+-]\s*{TOKEN})*)\s*:\s*(?P<new>.*)", re.DOTALL)


def _kept(frame: TagFrame, places) -> TagFrame:
    return frame.rebuilt([frame.columns[i] for i in places], [F.col(f"c{i}") for i in places])


def include(frame: TagFrame, includes) -> TagFrame:
    return _kept(frame, frame.places(includes))


def exclude(frame: TagFrame, excludes, skip_untagged: bool) -> TagFrame:
    gone = set(frame.places(excludes)) if excludes else set()
    gone |= {i for i, c in enumerate(frame.columns) if skip_untagged and c.tag is None}
    return _kept(frame, [i for i in range(len(frame.columns)) if i not in gone])


def parse_new_column(spec) -> tuple[TagColumn, str]:
    """(column, value) of "Header#tag+attr=value" or of such a pair."""
    if not isinstance(spec, str):
        column, value = spec
        return (column if isinstance(column, TagColumn) else TagColumn.parse(column)), value
    head, mark, value = spec.partition("=")
    if not mark:
        raise PatternError(f"a new column needs a value: {spec!r}")
    return TagColumn.parse(head), value


def add(frame: TagFrame, specs, before: bool, typed: bool) -> TagFrame:
    """New columns after (before) the others. Values may hold {{formulas}}; a typed one that is all formula keeps its type, others are text."""
    parsed = [parse_new_column(s) for s in ([specs] if isinstance(specs, str) else specs)]
    made = []
    for _, value in parsed:
        formula = sole_formula(value) if typed else None
        made.append(compile_formula(formula, frame.cells).column if formula else compile_template(value, frame.cells))
    new, old = [c for c, _ in parsed], [F.col(f"c{i}") for i in range(len(frame.columns))]
    if before:
        return frame.rebuilt([*new, *frame.columns], [*made, *old])
    return frame.rebuilt([*frame.columns, *new], [*old, *made])


def rename(frame: TagFrame, specs) -> TagFrame:
    """New tagspecs (and headers, where given) by "Header#pattern:New header#tag"; the first spec that fits wins. Costs Spark nothing."""
    rules = []
    for spec in [specs] if isinstance(specs, str) else specs:
        m = _RENAME.fullmatch(spec) if isinstance(spec, str) else None
        if isinstance(spec, str) and not m:
            raise PatternError(f"not a renaming: {spec!r}")
        header, pattern, new = (m["header"].strip(), m["pattern"], m["new"]) if m else (spec[2] if len(spec) > 2 else "", spec[0], spec[1])
        rules.append((nz.python_norm_string(header), TagPattern.parse(pattern), new if isinstance(new, TagColumn) else TagColumn.parse(new)))
    out = []
    for c in frame.columns:
        fit = next((new for h, p, new in rules if p.matches(c) and (not h or h == nz.python_norm_string(c.header))), None)
        out.append(c if fit is None else replace(fit, header=fit.header or c.header, source=c.source))
    return replace(frame, columns=tuple(out))
