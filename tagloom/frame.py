"""TagFrame: tagged columns over a lazy DataFrame. Every operator returns a new frame and runs nothing."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import TagsNotFoundError
from .functions import normalize as nz
from .functions.formulas import Value, compile_formula, first_value
from .plans.patterns import TagColumn, TagPattern, find_any, tags_of

_serial = itertools.count()


def order_name() -> str:
    """A name for a hidden column that keeps row order."""
    return f"_o{next(_serial)}"


@dataclass(frozen=True)
class TagFrame:
    """columns describe the physical columns c0, c1, ... of df; order names hidden columns (and whether they ascend) that put rows in their promised order. Nothing is sorted until an operator or a sink needs it."""

    columns: tuple[TagColumn, ...]
    df: DataFrame
    order: tuple[tuple[str, bool], ...] = ()

    # -- making frames ---------------------------------------------------------------------------------------------

    @staticmethod
    def from_df(df: DataFrame, tags: dict[str, str] | Sequence[str | None], order_by: Sequence[str] = ()) -> TagFrame:
        """Tag a DataFrame: tags maps names to tagspecs (others are untagged), or lists them in order. order_by names columns that give the row order."""
        specs = [tags.get(n) for n in df.columns if n not in order_by or n in tags] if isinstance(tags, dict) else list(tags)
        names = [n for n in df.columns if n not in order_by or (isinstance(tags, dict) and n in tags)]
        columns = [TagColumn.parse(s, header=n, source=i) if s else TagColumn(header=n, source=i) for i, (n, s) in enumerate(zip(names, specs, strict=True))]
        hidden = [order_name() for _ in order_by]
        physical = [df[f"`{n}`"].alias(f"c{i}") for i, n in enumerate(names)] + [df[f"`{n}`"].alias(h) for n, h in zip(order_by, hidden, strict=True)]
        return TagFrame(tuple(columns), df.select(*physical), tuple((h, True) for h in hidden))

    @staticmethod
    def from_rows(spark: SparkSession, rows: Iterable[Sequence[object]]) -> TagFrame:
        """Frame of raw rows, of which one of the first 25 holds hashtags. Cells become text; short rows are padded, long ones cut."""
        rows = [list(r) for r in rows]
        for at, row in enumerate(rows[:25]):
            if columns := tags_of(row, rows[at - 1] if at else None):
                return TagFrame.from_cells(spark, columns, rows[at + 1 :])
        raise TagsNotFoundError("no row of hashtags in the first 25 rows")

    @staticmethod
    def from_cells(spark: SparkSession, columns: Sequence[TagColumn], rows: Iterable[Sequence[object]]) -> TagFrame:
        width = len(columns)
        text = lambda v: "" if v is None else str(v)
        data = [(*(text(v) for v in r[:width]), *[""] * (width - len(r)), i) for i, r in enumerate(rows)]
        name = order_name()
        schema = T.StructType([*(T.StructField(f"c{i}", T.StringType()) for i in range(width)), T.StructField(name, T.LongType())])
        return TagFrame(tuple(columns), spark.createDataFrame(data, schema), ((name, True),))

    # -- looking at frames -----------------------------------------------------------------------------------------

    @property
    def tags(self) -> list[str | None]:
        return [c.tag for c in self.columns]

    @property
    def display_tags(self) -> list[str]:
        return [c.display_tag for c in self.columns]

    @property
    def headers(self) -> list[str]:
        return [c.header or "" for c in self.columns]

    @property
    def has_headers(self) -> bool:
        return any(self.headers)

    def type(self, i: int) -> T.DataType:
        return self.df.schema[f"c{i}"].dataType

    def cell(self, i: int) -> Value:
        return Value(F.col(f"c{i}"), self.type(i))

    def cells(self, pattern: TagPattern | str) -> list[Value]:
        return [self.cell(i) for i in TagPattern.parse(pattern).find(self.columns)]

    def places(self, patterns) -> list[int]:
        return find_any(TagPattern.parse_list(patterns), self.columns)

    def get(self, pattern, index: int | None = None, default: object = None) -> Column:
        """First cell, of those that a pattern matches, that is not the empty string; or the index-th of them."""
        found = self.cells(pattern)
        if index is not None:
            found = found[index : index + 1]
        if not found:
            return F.lit(default)
        value = nz.truthy(first_value(found).column, first_value(found).type) if index is None else found[0].column
        return value if default is None else F.coalesce(value, F.lit(default))

    def get_all(self, pattern) -> Column:
        """All cells that a pattern matches, as an array of text."""
        found = [c.text() for c in self.cells(pattern)]
        return F.array(*found) if found else F.array().cast("array<string>")

    def dictionary(self) -> Column:
        """The row as a map from tagspecs, attributes sorted, to text; of equal tagspecs the first counts."""
        names = [c.sorted_tag for c in self.columns]
        first = [i for i, n in enumerate(names) if n and names.index(n) == i]
        return F.create_map(*(x for i in first for x in (F.lit(names[i]), self.cell(i).text())))

    def formula(self, formula: str) -> Column:
        """A formula over this frame's rows as a column of its own type."""
        return compile_formula(formula, self.cells).column

    # -- building frames -------------------------------------------------------------------------------------------

    def rebuilt(self, columns: Sequence[TagColumn], cells: Sequence[Column], df: DataFrame | None = None, order=None) -> TagFrame:
        order = self.order if order is None else tuple(order)
        df = (self.df if df is None else df).select(*(c.alias(f"c{i}") for i, c in enumerate(cells)), *(F.col(n) for n, _ in order))
        return TagFrame(tuple(columns), df, order)

    def with_df(self, df: DataFrame) -> TagFrame:
        return replace(self, df=df)

    def changed(self, change: dict[int, Column]) -> TagFrame:
        """The frame with some cells computed anew, all in one projection."""
        return self.rebuilt(self.columns, [change.get(i, F.col(f"c{i}")) for i in range(len(self.columns))]) if change else self

    def transform(self, function: Callable[[DataFrame], DataFrame]) -> TagFrame:
        """Any DataFrame function that keeps the physical columns: the way to add operators of one's own."""
        return self.with_df(function(self.df))

    def map_rows(self, function: Callable[[Iterable], Iterable], columns: Sequence[str] | None = None) -> TagFrame:
        """Any Python over batches of rows as pandas frames with columns c0, c1, ...: for what no expression can say. columns gives new tagspecs, whose cells are text; by default cells keep their types."""
        made = [TagColumn.parse(c) for c in columns] if columns else list(self.columns)
        cells = self.df.select(*(f"c{i}" for i in range(len(self.columns))))
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(made))]) if columns else cells.schema
        return TagFrame(tuple(made), cells.mapInPandas(function, schema))

    def order_columns(self) -> list[Column]:
        return [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in self.order]

    def ordered(self) -> DataFrame:
        """The rows in their promised order, hidden columns included."""
        return self.df.orderBy(*self.order_columns()) if self.order else self.df

    def to_df(self, *names: str, ordered: bool = False) -> DataFrame:
        """A plain DataFrame, by default with headers or tags as unique names; null stands for empty native cells."""
        names = list(names) or unique_names([c.header or c.display_tag or f"column{i}" for i, c in enumerate(self.columns)])
        df = self.ordered() if ordered else self.df
        return df.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))

    def texts(self) -> list[Column]:
        return [nz.as_text(c.column, c.type) for c in map(self.cell, range(len(self.columns)))]

    def collect(self) -> list[list[str]]:
        """Rows of a small frame in order as lists of text, fetched at once."""
        return [list(r) for r in self.ordered().select(*(t.alias(f"c{i}") for i, t in enumerate(self.texts()))).collect()]

    def rows(self) -> Iterable[list[str]]:
        """Rows in order as lists of text, fetched partition by partition."""
        df = self.ordered().select(*(t.alias(f"c{i}") for i, t in enumerate(self.texts())))
        for r in df.toLocalIterator():
            yield list(r)

    # -- operators -------------------------------------------------------------------------------------------------

    def with_rows(self, queries, mask=None) -> TagFrame:
        return rows.select_rows(self, queries, mask, reverse=False)

    def without_rows(self, queries, mask=None) -> TagFrame:
        return rows.select_rows(self, queries, mask, reverse=True)

    def with_columns(self, includes) -> TagFrame:
        return columns.include(self, includes)

    def without_columns(self, excludes=None, skip_untagged: bool = False) -> TagFrame:
        return columns.exclude(self, excludes, skip_untagged)

    def add_columns(self, specs, before: bool = False, typed: bool = False) -> TagFrame:
        return columns.add(self, specs, before, typed)

    def rename_columns(self, specs) -> TagFrame:
        return columns.rename(self, specs)

    def sort(self, keys=None, reverse: bool = False) -> TagFrame:
        return rows.sort(self, keys, reverse)

    def cache(self, max_rows: int | None = None) -> TagFrame:
        return rows.cache(self, max_rows)

    def dedup(self, patterns=None, queries=None) -> TagFrame:
        return rows.dedup(self, patterns, queries)

    def row_counter(self, queries=None) -> rows.RowCounter:
        return rows.RowCounter.over(self, queries)

    def fill_data(self, patterns=None, queries=None) -> TagFrame:
        return rows.fill(self, patterns, queries)

    def count(self, patterns=None, aggregators=None, queries=None) -> TagFrame:
        return group.count(self, patterns, aggregators, queries)

    def value_set(self, pattern=None, normalise: bool = False) -> DataFrame:
        return group.value_set(self, pattern, normalise)

    def min(self, pattern) -> DataFrame:
        return group.extreme(self, pattern, True)

    def max(self, pattern) -> DataFrame:
        return group.extreme(self, pattern, False)

    def append(self, sources, add_columns: bool = True, queries=None) -> TagFrame:
        return combine.append(self, sources, add_columns, queries)

    def append_external_list(self, source, add_columns: bool = True, queries=None) -> TagFrame:
        return combine.append_external_list(self, source, add_columns, queries)

    def merge_data(self, source, keys, tags, replace: bool = False, overwrite: bool = False, queries=None) -> TagFrame:
        return combine.merge(self, source, keys, tags, replace, overwrite, queries)

    def expand_lists(self, patterns=None, separator: str = "|", correlate: bool = False, queries=None) -> TagFrame:
        return reshape.expand_lists(self, patterns, separator, correlate, queries)

    def explode(self, header_attribute: str = "header", value_attribute: str = "value") -> TagFrame:
        return reshape.explode(self, header_attribute, value_attribute)

    def implode(self, label_pattern, value_pattern, labels: Sequence[str] | None = None) -> TagFrame:
        return reshape.implode(self, label_pattern, value_pattern, labels)

    def clean_data(self, **options) -> TagFrame:
        return cells.clean(self, **options)

    def replace_data(self, original, replacement, pattern=None, use_regex: bool = False, queries=None) -> TagFrame:
        return cells.replace_cells(self, [cells.Replacement(original, replacement or "", pattern, use_regex)], queries)

    def replace_data_map(self, source, queries=None) -> TagFrame:
        return cells.replace_map(self, source, queries)

    def jsonpath(self, path: str, patterns=None, queries=None, use_json: bool = True, native: bool = False) -> TagFrame:
        return cells.jsonpath(self, path, patterns, queries, use_json, native)

    def validate(self, schema=None):
        from .validation import validate

        return validate(self, schema)


def unique_names(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n.lower()] = k = seen.get(n.lower(), 0) + 1
        out.append(n if k == 1 else f"{n}_{k}")
    return out


from .operators import cells, columns, combine, group, reshape, rows  # noqa: E402  they use TagFrame themselves
