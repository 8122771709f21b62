"""Operators on two frames: append rows, merge columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PatternError
from ..frame import TagFrame, order_name
from ..functions import normalize as nz
from ..functions.formulas import TEXT, Value
from ..plans.patterns import TagPattern
from ..plans.predicates import any_query


def frames_of(source) -> list[TagFrame]:
    """One frame or many: a frame, anything data() reads, or a list of such."""
    from ..sources.readers import data, is_list_of_sources

    if isinstance(source, TagFrame):
        return [source]
    if is_list_of_sources(source):
        return [f for s in source for f in frames_of(s)]
    return [data(source)]


def append(frame: TagFrame, sources, add_columns: bool, queries) -> TagFrame:
    """Rows of frame, then of each source. Columns meet by tag and attributes, each once; what a side lacks is empty. queries choose rows of the sources."""
    columns = list(frame.columns)
    parts: list[tuple[TagFrame, dict[int, int]]] = [(frame, {i: i for i in range(len(columns))})]
    for other in frames_of(sources):
        test = any_query(other, queries)
        other = other if test is None else other.with_df(other.df.where(test))
        placed: dict[int, int] = {}
        for j, c in enumerate(other.columns):
            at = next((i for i, k in enumerate(columns) if i not in placed and k.tag is not None and k.key == c.key), None)
            if at is None and add_columns and c.tag is not None:
                columns.append(c)
                at = len(columns) - 1
            if at is not None:
                placed[at] = j
        parts.append((other, placed))
    kinds = [{str(f.type(p[i])): f.type(p[i]) for f, p in parts if i in p} for i in range(len(columns))]
    source = order_name()
    hidden = [(order_name(), k, n, up) for k, (f, _) in enumerate(parts) for n, up in f.order]
    tables = []
    for k, (f, placed) in enumerate(parts):
        cells = [_aligned(f.cell(placed[i]) if i in placed else None, kinds[i]) for i in range(len(columns))]
        order = [(F.col(n) if own == k else F.lit(None).cast(parts[own][0].df.schema[n].dataType)).alias(h) for h, own, n, _ in hidden]
        tables.append(f.df.select(*(c.alias(f"c{i}") for i, c in enumerate(cells)), F.lit(k).alias(source), *order))
    df = tables[0]
    for t in tables[1:]:
        df = df.union(t)
    return TagFrame(tuple(columns), df, ((source, True), *((h, up) for h, _, _, up in hidden)))


def _aligned(cell: Value | None, kinds: dict) -> Column:
    """A cell in the type that all sides share, or as text if they differ."""
    if len(kinds) == 1:
        (kind,) = kinds.values()
        return cell.column if cell else F.lit("") if nz.is_text(kind) else F.lit(None).cast(kind)
    return cell.text() if cell else F.lit("")


def append_external_list(frame: TagFrame, source, add_columns: bool, queries) -> TagFrame:
    """Append every source that a frame lists in its column #x_source."""
    (listed,) = frames_of(source)
    cells = listed.cells("#x_source")
    if not cells:
        raise PatternError("the list of sources has no column #x_source")
    names = [r[0] for r in listed.ordered().select(cells[0].text().alias("s")).where("s <> ''").collect()]
    return append(frame, names, add_columns, queries) if names else frame


def _keys(frame: TagFrame, patterns: Sequence[TagPattern], native: bool) -> list[list[Column]]:
    """For each choice of one column a pattern, its key columns."""
    found = [frame.cells(p) for p in patterns]
    return [[c.column if native else nz.norm_string(c.column, c.type) for c in choice] for choice in product(*found)] if all(found) else []


def merge(frame: TagFrame, source, keys, tags, replace: bool, overwrite: bool, queries) -> TagFrame:
    """Look up columns of another frame by keys; never adds rows.

    Keys are compared after normalisation, as they are if both sides are whole numbers. Of several rows with a key the
    last counts. If several columns match a key's pattern each is tried, and the last that finds something counts. New
    columns follow; with replace, columns that are there already are filled where empty, or always with overwrite.
    """
    (right,) = frames_of(source)
    test = any_query(right, queries)
    right = right if test is None else right.with_df(right.df.where(test))
    patterns, wanted = TagPattern.parse_list(keys), TagPattern.parse_list(tags)
    if not patterns:
        raise PatternError("a merge needs keys")
    both = [frame.cells(p) + right.cells(p) for p in patterns]
    native = all(c and all(isinstance(x.type, nz.T.IntegralType) for x in c) for c in both)
    taken = [i for p in wanted for i in p.find(right.columns)]
    names = [f"_v{k}" for k in range(len(taken))]
    targets: dict[int, int] = {}  # taken column -> column of frame that it fills
    if replace:
        for k, i in enumerate(taken):
            pattern = next(p for p in wanted if p.matches(right.columns[i]))
            target = pattern.first(frame.columns)
            if target is not None:
                targets[k] = target
    order = F.struct(*(F.col(n) for n, _ in right.order)) if right.order else F.lit(0)
    last = F.max_by if all(up for _, up in right.order) else F.min_by
    choices = _keys(right, patterns, native)
    df = frame.df
    found: list[list[Column]] = [[] for _ in names]
    if choices:
        key = F.struct(*(c.alias(f"k{j}") for j, c in enumerate(choices[0]))) if len(choices) == 1 else F.explode(F.array_distinct(F.array(*(F.struct(*(c.alias(f"k{j}") for j, c in enumerate(ch))) for ch in choices))))
        values = F.struct(*(F.col(f"c{i}").alias(n) for i, n in zip(taken, names, strict=True)))
        table = right.df.select(key.alias("k"), values.alias("v"), order.alias("o")).groupBy(*(F.col(f"k.k{j}").alias(f"_k{j}") for j in range(len(patterns)))).agg(last("v", "o").alias("v"))
        for n, choice in enumerate(_keys(frame, patterns, native)):
            side = table.select(*(F.col(f"_k{j}").alias(f"_k{n}_{j}") for j in range(len(patterns))), *(F.col(f"v.{name}").alias(f"{name}_{n}") for name in names))
            df = df.join(side, [c == F.col(f"_k{n}_{j}") for j, c in enumerate(choice)], "left")
            for k, name in enumerate(names):
                found[k].append(F.col(f"{name}_{n}"))
    cells = {i: F.col(f"c{i}") for i in range(len(frame.columns))}
    columns, extra = list(frame.columns), []
    for k, i in enumerate(taken):
        kind = right.type(i)
        value = F.coalesce(*reversed(found[k])) if found[k] else F.lit(None).cast(kind)
        value = F.coalesce(value, F.lit("")) if nz.is_text(kind) else value
        if k in targets:
            at = targets[k]
            kept = nz.as_text(cells[at], frame.type(at)) if str(frame.type(at)) != str(kind) else cells[at]
            new = nz.as_text(value, kind) if str(frame.type(at)) != str(kind) else value
            matched = ~nz.is_empty(new, TEXT if str(frame.type(at)) != str(kind) else kind)
            open_ = matched if overwrite else matched & nz.is_empty(F.col(f"c{at}"), frame.type(at))
            cells[at] = F.when(open_, new).otherwise(kept)
        else:
            columns.append(right.columns[i])
            extra.append(value)
    return frame.rebuilt(columns, [*cells.values(), *extra], df)
