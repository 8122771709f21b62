"""Operators that change the shape: lists to rows, wide to long, long to wide."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PatternError
from ..frame import TagFrame, order_name
from ..functions import normalize as nz
from ..functions.formulas import TEXT
from ..plans.patterns import TagPattern
from ..plans.predicates import any_query, surely


def expand_lists(frame: TagFrame, patterns, separator: str, correlate: bool, queries) -> TagFrame:
    """A row for each combination of list items (correlate: for each place in the lists). Rows that pass no query stay whole."""
    places = frame.places(patterns) if patterns else [i for i, c in enumerate(frame.columns) if "list" in c.attributes]
    if not places:
        return frame
    columns = [c.without("list") if i in places else c for i, c in enumerate(frame.columns)]
    inside = any_query(frame, queries)
    lists = {}
    for i in places:
        text = nz.as_text(F.col(f"c{i}"), frame.type(i))
        items = F.transform(F.split(text, re.escape(separator or "|"), -1), lambda x: nz.norm_space(x, TEXT))
        lists[i] = items if inside is None else F.when(surely(inside), items).otherwise(F.array(text))
    name = order_name()
    if correlate:
        zipped = F.arrays_zip(*(a.alias(f"x{i}") for i, a in lists.items()))
        df = frame.df.select("*", F.posexplode(zipped).alias(name, "_z"))
        cells = [F.coalesce(F.col(f"_z.x{i}"), F.lit("")) if i in lists else F.col(f"c{i}") for i in range(len(columns))]
        return frame.rebuilt(columns, cells, df, (*frame.order, (name, True)))
    df, order = frame.df, list(frame.order)
    for i, items in lists.items():
        name = order_name()
        df = df.select("*", F.posexplode(items).alias(name, f"_x{i}"))
        order.append((name, True))
    cells = [F.col(f"_x{i}") if i in lists else F.col(f"c{i}") for i in range(len(columns))]
    return frame.rebuilt(columns, cells, df, order)


def explode(frame: TagFrame, header_attribute: str, value_attribute: str) -> TagFrame:
    """Columns with +label become rows of header and value; columns that are alike form one group, groups multiply."""
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(frame.columns):
        if "label" in c.attributes:
            groups.setdefault(c.key, []).append(i)
    if not groups:
        return frame
    df, order, made = frame.df, list(frame.order), {}
    for k, places in enumerate(groups.values()):
        cells = [frame.cell(i) for i in places]
        native = len({str(c.type) for c in cells}) == 1
        pairs = [F.struct(F.lit(frame.columns[i].header or "").alias("h"), (c.column if native else c.text()).alias("v")) for i, c in zip(places, cells, strict=True)]
        name = order_name()
        df = df.select("*", F.posexplode(F.array(*pairs)).alias(name, f"_p{k}"))
        order.append((name, True))
        made[places[0]] = k
    columns, out = [], []
    labelled = {i for places in groups.values() for i in places}
    for i, c in enumerate(frame.columns):
        if i in made:
            base = replace(c.without("label"), header=None)
            columns += [base.adding(header_attribute), base.adding(value_attribute)]
            out += [F.col(f"_p{made[i]}.h"), F.col(f"_p{made[i]}.v")]
        elif i not in labelled:
            columns.append(c)
            out.append(F.col(f"c{i}"))
    return frame.rebuilt(columns, out, df, order)


def implode(frame: TagFrame, label_pattern, value_pattern, labels: Sequence[str] | None) -> TagFrame:
    """Long to wide: a column for each label in sorted order, a row for each combination of the other columns, in order of first appearance; the first value counts.

    Unless labels are given, one job finds them: they are the result's columns, so they must be few.
    """
    label, value = (TagPattern.parse(p).first(frame.columns) for p in (label_pattern, value_pattern))
    if label is None or value is None:
        raise PatternError(f"no column for {label_pattern} or {value_pattern}")
    text = nz.norm_space(F.col(f"c{label}"), frame.type(label))
    if labels is None:
        labels = sorted(r[0] for r in frame.df.select(text.alias("l")).distinct().collect())
    keys = [i for i in range(len(frame.columns)) if i not in (label, value)]
    cell, order = F.col(f"c{value}"), F.struct(*(F.col(n) for n, _ in frame.order)) if frame.order else F.lit(0)
    up = all(u for _, u in frame.order)
    first = (F.min_by if up else F.max_by)
    made: list[Column] = [first(F.when(text == x, cell), F.when(text == x, order)) for x in labels]
    if nz.is_text(frame.type(value)):
        made = [F.coalesce(m, F.lit("")) for m in made]
    name = order_name()
    df = frame.df.groupBy(*(F.col(f"c{i}").alias(f"k{i}") for i in keys)).agg((F.min if up else F.max)(order).alias(name), *(m.alias(f"v{k}") for k, m in enumerate(made)))
    base = replace(frame.columns[value], header=None, source=None)
    columns = [*(frame.columns[i] for i in keys), *(replace(base, header=x).adding("label") for x in labels)]
    cells = [*(F.col(f"k{i}") for i in keys), *(F.col(f"v{k}") for k in range(len(labels)))]
    return frame.rebuilt(columns, cells, df, ((name, up),))
