"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A-Z to a-z and nothing else, as translate() arguments.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module_name: str) -> None:
    """Send a kernel module to the Python workers by value, so that executors need no installed copy."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and all runs in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    The files survive the loss of an executor. They stay until clear_tables() or the folder's owner removes them,
    since the lazily evaluated result may still read them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tagloom-tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Remove every table that materialise() wrote in this session's shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tagloom-tables")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes up to which a table is broadcast, unless a caller says otherwise.
BROADCAST = 32 << 20


def fits(df: DataFrame, most: int) -> bool:
    """Whether the rows of a written table have at most `most` bytes: 16 a column, and the lengths of what is not of fixed size."""
    sizes = []
    for c in df.schema:
        kind = c.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.sum(F.octet_length(c.name)))
        elif kind in ("array", "map", "struct"):
            sizes.append(F.sum(F.octet_length(F.to_json(F.struct(c.name)))))
    n, *held = df.agg(F.count(F.lit(1)), *sizes).first()
    return n * 16 * len(df.columns) + sum(x or 0 for x in held) <= most


def within(df: DataFrame, most: int) -> DataFrame:
    """df for a join: to be broadcast if it fits into `most` bytes, else to be shuffled along with the other side."""
    return F.broadcast(df) if fits(df, most) else df.hint("merge")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def least_hashes(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Different rows of df (group, key) with the n least hashes of key in each group: a bounded sample that depends on keys alone.

    Repeated rows are one; null keys have a hash like any other. Sizes of groups are counted with partial sums and are
    one row a group; hashes well beyond the expected limit go where they are read, so that no task of the window sees
    more than about 2 n + 32 rows of a group, whatever the group's size.
    """
    each = materialise(df.select(group, key).distinct(), "keys")
    sizes = materialise(each.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    fraction = F.shiftrightunsigned(F.xxhash64(key), 1) / float(1 << 63)
    near = each.join(within(sizes, BROADCAST), F.col(group).eqNullSafe(F.col("_g"))).where(fraction * F.col("_n") <= 2 * n + 32)
    order = Window.partitionBy(group).orderBy(fraction, key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).select(group, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
