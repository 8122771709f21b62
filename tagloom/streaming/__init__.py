"""Tagged frames over unbounded streams.

Operators without memory (rows, columns, cells, lists, append, merge with a static frame) work on a stream as they do
on a table. count() works in complete mode, or in append mode under a watermark. The functions here replace those that
need row order: a stream has none but arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..frame import TagFrame
from ..functions import normalize as nz
from ..operators.rows import row_key
from ..plans.predicates import any_query, surely
from ..sources.tagger import Specs, tag


def stream_frame(df: DataFrame, specs: Specs, match_all: bool = True) -> TagFrame:
    """A frame over a streaming DataFrame, tagged by column names."""
    if not df.isStreaming:
        raise ValueError("not a streaming DataFrame")
    return tag(df, specs, match_all=match_all)


def with_watermark(frame: TagFrame, pattern, delay: str) -> TagFrame:
    """Declare how late rows may be, by the first column that the pattern matches."""
    return frame.transform(lambda df: df.withWatermark(f"c{frame.places(pattern)[0]}", delay))


def dedup(frame: TagFrame, patterns=None, queries=None, within_watermark: bool = False) -> TagFrame:
    """One row of each key, the first to arrive; rows that pass no query all stay. within_watermark forgets keys beyond the watermark."""
    test = any_query(frame, queries)
    keys = {f"_k{i}": k for i, k in enumerate(row_key(frame, patterns))}
    keyed = frame.df.withColumns(keys) if test is None else frame.df.where(test).withColumns(keys)
    kept = (keyed.dropDuplicatesWithinWatermark if within_watermark else keyed.dropDuplicates)(list(keys)).drop(*keys)
    return frame.with_df(kept if test is None else kept.union(frame.df.where(~surely(test))))


def windowed_count(frame: TagFrame, time_pattern, width: str, patterns=None, slide: str | None = None) -> DataFrame:
    """(start, end, keys..., rows): rows by time window, tumbling or sliding, and by the first column of each pattern."""
    time = F.col(f"c{frame.places(time_pattern)[0]}")
    keys: list[Column] = [F.col(f"c{i}").alias(frame.columns[i].header or frame.columns[i].display_tag) for i in (frame.places(patterns) if patterns else [])]
    counted = frame.df.groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in counted.columns if c not in ("w",)])


def fill_down(frame: TagFrame, partition_by, patterns=None) -> TagFrame:
    """Empty text cells take the last value that arrived before in their column, within each key of partition_by. Its state is one row a key."""
    places = [i for i in (frame.places(patterns) if patterns else range(len(frame.columns))) if nz.is_text(frame.type(i))]
    names, fill = [f"c{i}" for i in range(len(frame.columns))], [f"c{i}" for i in places]
    key = F.concat_ws("\x1f", *(nz.norm_string(F.col(f"c{i}"), frame.type(i)) for i in frame.places(partition_by)))

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else [""] * len(fill)
        for part in frames:
            part = part[names].copy()
            for k, name in enumerate(fill):
                values = part[name].where(part[name] != "")
                filled = values.ffill().fillna(last[k])
                part[name] = filled
                last[k] = str(filled.iloc[-1]) if len(filled) else last[k]
            yield part
        state.update(tuple(last))

    schema = frame.df.select(*names).schema
    shape = ", ".join(f"{n} string" for n in fill)
    out = frame.df.withColumn("_key", key).groupBy("_key").applyInPandasWithState(run, schema, shape, "append", GroupStateTimeout.NoTimeout)
    return TagFrame(frame.columns, out)
