"""Tagging data that has headers but no hashtags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TagsNotFoundError
from ..frame import TagFrame
from ..functions.normalize import python_norm_string
from ..plans.patterns import TagColumn

Specs = dict[str, str] | Sequence[tuple[str, str]]


def header_columns(headers: Sequence[object], specs: Specs, default_tag: str | None = None, match_all: bool = False) -> tuple[list[TagColumn], int]:
    """Columns for a row of headers, and how many specs' texts they hold. A header takes the first spec whose text it contains (match_all: equals)."""
    rules = [(python_norm_string(h), t) for h, t in (specs.items() if isinstance(specs, dict) else specs)]
    out, hits = [], 0
    for i, header in enumerate(headers):
        text = python_norm_string(header)
        tag = next((t for h, t in rules if h and t and (h == text if match_all else h in text)), None)
        hits += tag is not None
        tag = tag or (default_tag if text else None)
        shown = str(header).strip() if header is not None else None
        out.append(replace(TagColumn.parse(tag), header=shown, source=i) if tag else TagColumn(header=shown, source=i))
    return out, hits


def tag_rows(spark: SparkSession, rows: Sequence[Sequence[object]], specs: Specs, default_tag: str | None = None, match_all: bool = False) -> TagFrame:
    """Frame of raw rows, of which one of the first 25 has headers for at least half of the specs."""
    for at, row in enumerate(rows[:25]):
        columns, hits = header_columns(row, specs, default_tag, match_all)
        if hits and hits * 2 >= len(specs):
            return TagFrame.from_cells(spark, columns, rows[at + 1 :])
    raise TagsNotFoundError("no row of headers that fit the specs in the first 25 rows")


def tag(df: DataFrame, specs: Specs, default_tag: str | None = None, match_all: bool = False, order_by: Sequence[str] = ()) -> TagFrame:
    """Tag a DataFrame's columns by their names; types stay."""
    names = [n for n in df.columns if n not in order_by]
    columns, _ = header_columns(names, specs, default_tag, match_all)
    frame = TagFrame.from_df(df, [None] * len(names), order_by)
    return replace(frame, columns=tuple(columns))


def tag_parquet(spark: SparkSession, path: str, specs: Specs, default_tag: str | None = None, match_all: bool = True) -> TagFrame:
    """Tag Parquet files. Rows are ordered by file and place in it, which costs nothing until an operator asks."""
    df = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return tag(df, specs, default_tag, match_all, ("_file", "_row"))
