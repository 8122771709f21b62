"""Operators on cells: clean, replace, extract from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import TagFrame
from ..functions import normalize as nz
from ..functions.dates import norm_date
from ..functions.formulas import TEXT
from ..functions.geo import clean_place
from ..functions.json_path import evaluate, is_simple, steps
from ..plans.patterns import TagPattern
from ..plans.predicates import any_query, surely

#: Literal rules from which replace_map() joins instead of chaining conditions.
MANY_RULES = 200


def _places(frame: TagFrame, patterns) -> set[int]:
    if patterns in (None, False, "", []):
        return set()
    return set(range(len(frame.columns))) if patterns is True else set(frame.places(patterns))


def guess_dayfirst(frame: TagFrame, places) -> bool:
    """Whether dates like 01-02-2003 start with the day, by those that can only be read one way; one job, two numbers."""
    tests = []
    for i in places:
        if nz.is_text(frame.type(i)):
            a, b = (F.regexp_extract(F.col(f"c{i}"), r"^\s*(\d{1,2})[^\d:]+(\d{1,2})[^\d:]+\d+", g).try_cast("int") for g in (1, 2))
            tests.append((F.when((a > 12) & (b <= 12), 1).otherwise(0), F.when((a <= 12) & (b > 12), 1).otherwise(0)))
    if not tests:
        return True
    day, month = frame.df.agg(*(F.sum(sum(t[k] for t in tests)) for k in (0, 1))).first()
    return (day or 0) >= (month or 0)


def _formatter(kind: str, form: str):
    def one(value: str | None) -> str | None:
        try:
            return None if value is None else datetime.strptime(value, "%Y-%m-%d").strftime(form) if kind == "date" else format(nz.python_number(value), form)
        except (ValueError, TypeError):
            return value

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map({v: one(v) for v in values.unique()})

    return run


def clean(frame: TagFrame, whitespace=None, upper=None, lower=None, date=None, date_format=None, number=None, number_format=None, latlon=None, purge=False, queries=None, dayfirst=None, strict=False) -> TagFrame:
    """Clean the cells of the columns that each option's patterns match (True: all), in one projection: blanks, case, dates, numbers, places.

    What cannot be read stays, or becomes empty with purge. Whether days come before months is taken from the dates
    themselves unless dayfirst says so. Native times are dates already; native numbers stay as they are unless a format
    is given. strict raises for places out of range.
    """
    wanted = {k: _places(frame, p) for k, p in {"whitespace": whitespace, "upper": upper, "lower": lower, "date": date, "number": number, "latlon": latlon}.items()}
    inside = any_query(frame, queries)
    if wanted["date"] and dayfirst is None:
        dayfirst = guess_dayfirst(frame, wanted["date"])
    change = {}
    for i in sorted(set().union(*wanted.values())):
        c, t = F.col(f"c{i}"), frame.type(i)
        out = c
        if i in wanted["whitespace"] and nz.is_text(t):
            out = nz.norm_space(out, t)
        if i in wanted["upper"]:
            out, t = F.upper(nz.as_text(out, t)), TEXT
        if i in wanted["lower"]:
            out, t = F.lower(nz.as_text(out, t)), TEXT
        if i in wanted["date"]:
            day = norm_date(out, t, dayfirst)
            day = _formatter("date", date_format)(day) if date_format else day
            out, t = _cleaned(nz.as_text(out, t), day, purge), TEXT
        if i in wanted["number"] and (nz.is_text(t) or number_format):
            n = nz.number(out, t)
            if nz.is_text(t):
                n = F.coalesce(n, nz.number(F.regexp_replace(out, r"[^\de.]", ""), TEXT))
            shown = nz.render_number(n.cast("double"))
            out, t = _cleaned(nz.as_text(out, t), _formatter("number", number_format)(shown) if number_format else shown, purge), TEXT
        if i in wanted["latlon"]:
            kind = next((k for k in ("lat", "lon", "coord") if k in frame.columns[i].attributes), None)
            if kind:
                text = nz.as_text(out, t)
                out, t = _cleaned(text, clean_place(text, kind, strict), purge), TEXT
        if inside is not None:
            plain = c if str(frame.type(i)) == str(t) else nz.as_text(c, frame.type(i))
            out = F.when(surely(inside), out).otherwise(plain)
        change[i] = out
    return frame.changed(change)


def _cleaned(old: Column, new: Column, purge: bool) -> Column:
    return F.when(old == "", old).otherwise(F.coalesce(new, F.lit("") if purge else old))


@dataclass(frozen=True)
class Replacement:
    """One rule: cells equal to original, after normalisation, or matches of it as a regular expression."""

    original: str
    replacement: str
    pattern: object = None
    use_regex: bool = False

    def fits(self, frame: TagFrame, i: int) -> bool:
        patterns = TagPattern.parse_list(self.pattern)
        return not patterns or any(p.matches(frame.columns[i]) for p in patterns)

    def lower(self, frame: TagFrame, i: int) -> tuple[Column, Column]:
        """(whether it applies, what it makes of the cell)."""
        text = nz.as_text(F.col(f"c{i}"), frame.type(i))
        if self.use_regex:
            nz.check_regex(frame.df.sparkSession, self.original)
            regex = nz.java_regex(self.original)
            return text.rlike(regex), F.regexp_replace(text, regex, nz.java_replacement(self.replacement))
        return nz.norm_string(F.col(f"c{i}"), frame.type(i)) == nz.python_norm_string(self.original), F.lit(self.replacement)


def replace_cells(frame: TagFrame, rules: list[Replacement], queries) -> TagFrame:
    """The first rule that applies to a cell sets it; all rules and columns are one projection."""
    inside = any_query(frame, queries)
    change = {}
    for i in range(len(frame.columns)):
        own = [r.lower(frame, i) for r in rules if r.fits(frame, i)]
        if not own:
            continue
        cell = nz.as_text(F.col(f"c{i}"), frame.type(i))
        out = None
        for test, value in own:
            test = test if inside is None else test & surely(inside)
            out = F.when(test, value) if out is None else out.when(test, value)
        change[i] = out.otherwise(cell)
    return frame.changed(change)


def parse_map(source: TagFrame) -> list[Replacement]:
    """Rules from rows of #x_pattern, #x_substitution, #x_tag and #x_regex."""
    found = [source.cells(p) for p in ("#x_pattern", "#x_substitution", "#x_tag", "#x_regex")]
    rows = source.ordered().select(*((c[0].text() if c else F.lit("")).alias(f"v{i}") for i, c in enumerate(found))).collect()
    return [Replacement(r[0], r[1], r[2] or None, bool(r[3])) for r in rows if r[0]]


def replace_map(frame: TagFrame, source: TagFrame, queries) -> TagFrame:
    """Rules of a map. A long map of literals is joined by normalised text, the first row of a key counting; others chain."""
    rules = parse_map(source)
    if len(rules) <= MANY_RULES or any(r.use_regex for r in rules):
        return replace_cells(frame, rules, queries)
    inside = any_query(frame, queries)
    out = frame
    for i in range(len(frame.columns)):
        own = [(nz.python_norm_string(r.original), r.replacement, k) for k, r in enumerate(rules) if r.fits(frame, i)]
        if not own:
            continue
        table = frame.df.sparkSession.createDataFrame(own, "key string, value string, n int")
        table = table.groupBy("key").agg(F.min_by("value", "n").alias("value"))
        key = nz.norm_string(F.col(f"c{i}"), out.type(i))
        joined = out.df.join(table, key == F.col("key"), "left")
        test = F.col("value").isNotNull() if inside is None else F.col("value").isNotNull() & surely(inside)
        cell = F.when(test, F.col("value")).otherwise(nz.as_text(F.col(f"c{i}"), out.type(i)))
        out = out.rebuilt(out.columns, [cell if k == i else F.col(f"c{k}") for k in range(len(out.columns))], joined)
    return out


def _json_udf(path: str, use_json: bool):
    def one(text: str | None) -> str | None:
        try:
            found = evaluate(path, json.loads(text))
        except (ValueError, TypeError):
            return text
        if not found:
            return ""
        return flatten(found[0] if len(found) == 1 else found, use_json)

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map({v: one(v) for v in values.unique()})

    return run


def flatten(value: object, use_json: bool = True, separator: str = " | ") -> str:
    """A JSON value as a cell: scalars as text, lists and objects as JSON or joined."""
    if value is None:
        return ""
    if isinstance(value, (list, tuple, dict)):
        if use_json:
            return json.dumps(value)
        return separator.join(flatten(v, use_json, separator) for v in value)
    return str(value)


def jsonpath(frame: TagFrame, path: str, patterns, queries, use_json: bool, native: bool) -> TagFrame:
    """What a JSONPath finds in each cell; cells that are no JSON stay. native: keep to the JVM, for paths of names and places that find scalars."""
    steps(path)  # a path that cannot be read fails here, not in a task
    places = frame.places(patterns) if patterns else range(len(frame.columns))
    inside = any_query(frame, queries)
    udf = None if native and is_simple(path) else _json_udf(path, use_json)
    change = {}
    for i in places:
        text = nz.as_text(F.col(f"c{i}"), frame.type(i))
        if udf is None:
            valid = F.try_parse_json(text).isNotNull()
            out = F.when(valid, F.coalesce(F.get_json_object(text, path), F.lit(""))).otherwise(text)
        else:
            out = udf(text)
        change[i] = out if inside is None else F.when(surely(inside), out).otherwise(text)
    return frame.changed(change)


