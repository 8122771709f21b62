"""Operators on rows: select, sort, limit, deduplicate, fill down, count along the way."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import TagFrame, order_name
from ..functions import normalize as nz
from ..functions.formulas import Value
from ..plans.patterns import TagPattern
from ..plans.predicates import any_query, surely

#: Rows of a block of fill(), which are filled by themselves.
BLOCK = 1 << 16


def select_rows(frame: TagFrame, queries, mask, reverse: bool) -> TagFrame:
    """Rows that pass a query (reverse: none). Rows outside the mask stay; without queries all rows do."""
    test = any_query(frame, queries)
    if test is None:
        return frame
    keep = ~surely(test) if reverse else test
    inside = any_query(frame, mask)
    if inside is not None:
        keep = ~surely(inside) | surely(keep)
    return frame.with_df(frame.df.where(keep))  # a bare test reaches the scan


def sort(frame: TagFrame, keys, reverse: bool) -> TagFrame:
    """Declare an order: the first column of each pattern, or all columns. Reversing turns the keys, not equal rows."""
    patterns = TagPattern.parse_list(keys)
    found = [(p.first(frame.columns), p) for p in patterns] if patterns else [(i, None) for i in range(len(frame.columns))]
    hidden: list[tuple[str, Column]] = []
    for i, _ in found:
        if i is not None:
            hidden += [(order_name(), k) for k in nz.sort_keys(F.col(f"c{i}"), frame.type(i), frame.columns[i].tag == "#date")]
    df = frame.df.select("*", *(c.alias(n) for n, c in hidden))
    return TagFrame(frame.columns, df, (*((n, not reverse) for n, _ in hidden), *frame.order))


def cache(frame: TagFrame, max_rows: int | None) -> TagFrame:
    """Keep computed rows for reuse, or the first max_rows of them."""
    if max_rows is None:
        return frame.with_df(frame.df.persist())
    return frame.with_df(frame.ordered().limit(max_rows))


def overflow(frame: TagFrame, max_rows: int) -> bool:
    """Whether a frame has more rows than a limit keeps."""
    return frame.df.limit(max_rows + 1).count() > max_rows


def row_key(frame: TagFrame, patterns) -> list[Column]:
    """Typed keys of the columns that the patterns match, or of all columns."""
    places = frame.places(patterns) or range(len(frame.columns))
    return [key_of(frame.cell(i), frame.columns[i].tag == "#date") for i in places]


def key_of(cell: Value, date: bool = False) -> Column:
    """What makes two cells equal; native cells are their own key."""
    if isinstance(cell.type, (T.NumericType, T.BooleanType)) or nz.is_time_type(cell.type):
        return cell.column
    return nz.typed_key(cell.column, cell.type, date)


def dedup(frame: TagFrame, patterns, queries) -> TagFrame:
    """The first row of each key; rows that pass no query all stay.

    The first row is an aggregate (min_by), combined before the shuffle, so a key with most of the rows is no burden to
    one task, as it would be in a window.
    """
    test = any_query(frame, queries)
    inside = frame.df if test is None else frame.df.where(test)
    keys = [k.alias(f"_k{i}") for i, k in enumerate(row_key(frame, patterns))]
    row = F.struct(*(F.col(c) for c in frame.df.columns))
    order = F.struct(*(F.col(n) for n, _ in frame.order)) if frame.order else F.lit(0)
    pick = F.min_by(row, order) if all(up for _, up in frame.order) else F.max_by(row, order) if not any(up for _, up in frame.order) else None
    if pick is None:
        first = Window.partitionBy(*keys).orderBy(*frame.order_columns())
        kept = inside.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    else:
        kept = inside.groupBy(*keys).agg(pick.alias("_r")).select("_r.*")
    if test is not None:
        kept = kept.unionByName(frame.df.where(~surely(test)))
    return frame.with_df(kept)


@dataclass
class RowCounter:
    """A frame that counts, while it runs, the rows that pass the queries."""

    frame: TagFrame
    observation: Observation

    @staticmethod
    def over(frame: TagFrame, queries) -> RowCounter:
        observation = Observation()
        counted = F.count_if(surely(any_query(frame, queries)))
        # Rows are counted behind the sort: finding its ranges reads what is below it twice.
        return RowCounter(TagFrame(frame.columns, frame.ordered().observe(observation, counted.alias("rows"))), observation)

    @property
    def row_count(self) -> int:
        """Rows counted; waits for the frame's first run."""
        return self.observation.get["rows"]


def fill(frame: TagFrame, patterns, queries) -> TagFrame:
    """Empty cells take the last value above in their column; only in rows that pass the queries.

    Rows whose order ends in a whole number are filled in blocks of BLOCK, each by itself; what the first rows of a
    block lack comes from a table with one row a block. Other orders need one pass over all rows.
    """
    places = frame.places(patterns) if patterns else list(range(len(frame.columns)))
    inside = any_query(frame, queries)
    cells = {i: nz.truthy(F.col(f"c{i}"), frame.type(i)) for i in places}
    blocked = bool(frame.order) and all(up for _, up in frame.order) and isinstance(frame.df.schema[frame.order[-1][0]].dataType, T.IntegralType)
    if not blocked:
        above = Window.orderBy(*frame.order_columns()).rowsBetween(Window.unboundedPreceding, 0)
        filled = {i: F.last(c, ignorenulls=True).over(above) for i, c in cells.items()}
        return frame.changed({i: _filled(frame, i, f, inside) for i, f in filled.items()})
    *groups, (last, _) = frame.order
    names = [f"_b{k}" for k in range(len(groups) + 1)]
    blocks = [F.col(n) for n, _ in groups] + [F.floor(F.col(last) / BLOCK)]
    df = frame.df.select("*", *(b.alias(n) for b, n in zip(blocks, names, strict=True)))
    within = Window.partitionBy(*names).orderBy(last).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(*names).agg(*(F.max_by(c, F.when(c.isNotNull(), F.col(last))).alias(f"_e{i}") for i, c in cells.items()))
    before = Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*(F.col(n).alias(f"{n}_") for n in names), *(F.last(f"_e{i}", ignorenulls=True).over(before).alias(f"_f{i}") for i in cells))
    joined = df.withColumns({f"_w{i}": F.last(c, ignorenulls=True).over(within) for i, c in cells.items()})
    joined = joined.join(carried, [F.col(n) == F.col(f"{n}_") for n in names])
    wide = frame.with_df(joined)
    change = {i: _filled(frame, i, F.coalesce(f"_w{i}", f"_f{i}"), inside) for i in cells}
    return wide.rebuilt(frame.columns, [change.get(i, F.col(f"c{i}")) for i in range(len(frame.columns))])


def _filled(frame: TagFrame, i: int, value: Column, inside: Column | None) -> Column:
    value = F.coalesce(value, F.lit("")) if nz.is_text(frame.type(i)) else value
    return value if inside is None else F.when(surely(inside), value).otherwise(F.col(f"c{i}"))
