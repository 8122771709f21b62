"""Analytics for tagged columns on Spark: see README.md."""

from .frame import TagFrame
from .plans.patterns import TagColumn, TagPattern
from .sources.readers import data
from .sources.tagger import tag, tag_parquet

__all__ = ["TagColumn", "TagFrame", "TagPattern", "data", "tag", "tag_parquet"]
