"""Writing frames: raw rows, CSV, JSON, hashes. Small results stream through the driver in order; large ones are written by the executors."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import TagFrame


def raw(frame: TagFrame, show_headers: bool = True, show_tags: bool = True) -> Iterator[list[str]]:
    """Headers, if there are any, then hashtags, then rows in order."""
    if show_headers and frame.has_headers:
        yield frame.headers
    if show_tags:
        yield frame.display_tags
    yield from frame.rows()


def csv_lines(frame: TagFrame, show_headers: bool = True, show_tags: bool = True) -> Iterator[str]:
    for row in raw(frame, show_headers, show_tags):
        out = io.StringIO()
        csv.writer(out).writerow(row)
        yield out.getvalue()


def json_lines(frame: TagFrame, show_headers: bool = True, show_tags: bool = True, use_objects: bool = False) -> Iterator[str]:
    """A JSON list, an item a line: rows, or objects by tagspec with attributes sorted, in which the first of equal tagspecs counts."""
    rows: Iterable[object]
    if use_objects:
        names = [c.sorted_tag for c in frame.columns]
        first = [names.index(n) == i and n != "" for i, n in enumerate(names)]
        rows = ({n: v for n, v, f in zip(names, r, first, strict=True) if f} for r in frame.rows())
    else:
        rows = raw(frame, show_headers, show_tags)
    yield "[\n"
    last = None
    for row in rows:
        if last is not None:
            yield f"    {last},\n"
        last = json.dumps(row)
    yield f"    {last}\n]\n" if last is not None else "]\n"


def write_csv(frame: TagFrame, path: str) -> None:
    """Large output: a folder of CSV parts in the frame's order, each headed by headers and hashtags, so that every part is a table of its own and read_csv() reads them all."""
    df = frame.ordered().select(F.array(*frame.texts()).alias("row"))
    heads = [F.array(*map(F.lit, r)) for r in ((frame.headers if frame.has_headers else None), frame.display_tags) if r]
    if df.isEmpty():
        headed = frame.df.sparkSession.range(1).coalesce(1).select(F.explode(F.array(*heads)).alias("row"))
    else:
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a partition
        headed = df.select(F.explode(F.when(first, F.array(*heads, F.col("row"))).otherwise(F.array(F.col("row")))).alias("row"))
    cells = [F.get("row", F.lit(i)).alias(f"c{i}") for i in range(len(frame.columns))]
    headed.select(*cells).write.csv(path, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(frame: TagFrame, path: str, mode: str = "error") -> None:
    """Cells with their types; tags, attributes and headers are the fields' metadata, so read_parquet() brings them back."""
    fields = [F.col(f"c{i}").alias(f"c{i}", metadata={"tag": c.display_tag, "header": c.header or ""}) for i, c in enumerate(frame.columns)]
    frame.ordered().select(*fields).write.mode(mode).parquet(path)


def read_parquet(spark, path: str) -> TagFrame:
    df = spark.read.parquet(path)
    tags = [f.metadata.get("tag") for f in df.schema.fields]
    headers = [f.metadata.get("header") or None for f in df.schema.fields]
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    frame = TagFrame.from_df(df, tags, ("_file", "_row"))
    from dataclasses import replace

    return replace(frame, columns=tuple(replace(c, header=h) for c, h in zip(frame.columns, headers, strict=True)))


def _spaced(values: Iterable[object]) -> Iterator[bytes]:
    for v in values:
        yield " ".join(str("" if v is None else v).split()).encode()


def columns_hash(frame: TagFrame) -> str:
    """MD5 of the headers and hashtags, blanks collapsed, in order."""
    return hashlib.md5(b"".join([*_spaced(frame.headers), *_spaced(frame.display_tags)])).hexdigest()


def data_hash(frame: TagFrame) -> str:
    """MD5 of headers, hashtags and all cells in order. Rows stream through the driver."""
    out = hashlib.md5(b"".join([*_spaced(frame.headers), *_spaced(frame.display_tags)]))
    for row in frame.rows():
        out.update(b"".join(_spaced(row)))
    return out.hexdigest()


def content_hash(frame: TagFrame) -> DataFrame:
    """(rows, hash): a checksum of the rows whatever their order, computed by the executors; for data too large for data_hash()."""
    return frame.df.select(F.xxhash64(*frame.texts()).alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("hash"))
