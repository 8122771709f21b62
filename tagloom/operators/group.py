"""Aggregation: count by key, sets of values, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import TagFrame, order_name
from ..functions import normalize as nz
from ..functions.aggregates import Aggregator
from ..functions.formulas import first_value
from ..plans.patterns import TagColumn, TagPattern
from ..plans.predicates import any_query


def count(frame: TagFrame, patterns, aggregators, queries) -> TagFrame:
    """Aggregates by the first non-empty value of each pattern, in order of the keys. A pattern without a column is an untagged, empty key. An empty input has no groups, even without keys."""
    test = any_query(frame, queries)
    base = frame if test is None else frame.with_df(frame.df.where(test))
    columns, keys = [], []
    for p in TagPattern.parse_list(patterns):
        cells = base.cells(p)
        value = first_value(cells) if cells else None
        columns.append(base.columns[p.first(base.columns)] if cells else TagColumn())
        if value is None:
            keys.append(F.lit(""))
        elif isinstance(value.type, (T.NumericType, T.BooleanType)) or nz.is_time_type(value.type):
            keys.append(value.column)
        else:
            keys.append(nz.norm_space(value.column, value.type))
    made = Aggregator.parse_list(aggregators)
    grouped = base.df.groupBy(*(k.alias(f"c{i}") for i, k in enumerate(keys))) if keys else base.df.groupBy(F.lit(1).alias("_one"))
    df = grouped.agg(*(a.lower(base).alias(f"c{len(keys) + i}") for i, a in enumerate(made)))
    hidden = [order_name() for _ in keys]
    df = df.select(*(F.col(f"c{i}") for i in range(len(keys) + len(made))), *(F.col(f"c{i}").alias(n) for i, n in enumerate(hidden)))
    return TagFrame((*columns, *(a.column for a in made)), df, tuple((n, True) for n in hidden))


def value_set(frame: TagFrame, pattern, normalise: bool) -> DataFrame:
    """(value): different values of all matching columns, or of all columns; of one native type as they are, else as text."""
    cells = frame.cells(pattern) if pattern else [frame.cell(i) for i in range(len(frame.columns))]
    if not cells:
        return frame.df.select(F.lit("").alias("value")).limit(0)
    same = len({str(c.type) for c in cells}) == 1 and not nz.is_text(cells[0].type)
    if normalise:
        values = [nz.norm_string(c.column, c.type) for c in cells]
    else:
        values = [c.column if same else c.text() for c in cells]
    one = values[0] if len(values) == 1 else F.explode(F.array(*values))
    return frame.df.select(one.alias("value")).distinct()


def extreme(frame: TagFrame, pattern, least: bool) -> DataFrame:
    """(value), one row: the raw value with the least or greatest typed key over all matching columns and rows."""
    pattern = TagPattern.parse(pattern)
    cells = frame.cells(pattern)
    if not cells:
        return frame.df.agg(F.max(F.lit(None).cast("string")).alias("value"))
    if len({str(c.type) for c in cells}) == 1 and (nz.is_number_type(cells[0].type) or nz.is_time_type(cells[0].type)):
        row = cells[0].column if len(cells) == 1 else (F.least if least else F.greatest)(*(c.column for c in cells))
        return frame.df.agg((F.min if least else F.max)(row).alias("value"))
    pairs = [F.when(~nz.is_empty(c.column, c.type), F.struct(nz.typed_key(c.column, c.type, pattern.tag == "#date").alias("k"), c.text().alias("v"))) for c in cells]
    each = frame.df.select(F.explode(F.array(*pairs)).alias("p"), *(F.col(n) for n, _ in frame.order)).where("p is not null")
    keyed = F.struct(F.col("p.k"), *(F.col(n) for n, _ in frame.order)) if least else F.col("p.k")
    return each.agg((F.min_by if least else F.max_by)(F.col("p.v"), keyed).alias("value"))
