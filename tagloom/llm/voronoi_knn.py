"""Exact top-k inner-product search as a Voronoi kNN join.

Vectors are lifted so that inner product becomes Euclidean distance: with M the largest data norm, x -> (x, sqrt(M^2 -
|x|^2)) and q -> (q, 0) give d^2 = |q|^2 + M^2 - 2<q, x>. Pivots cut the lifted space into Voronoi cells. One pass
summarises each cell (rows, least and greatest distance to its pivot, its k least distances). From the summaries each
cell of queries gets a bound on the distance of its k-th neighbour; a data row is sent to a group of cells only if the
triangle inequality does not rule it out for all of them. Groups are cells that lie next to each other, so that they need
much the same data; a cell with many queries is a group in several parts. Each (part, slice of data) pair is solved by
itself and the partial lists are merged. Where vectors lie in clusters a data row goes to few parts; where they fill the
space evenly no bound can rule much out, and the work is that of comparing all in blocks.

Memory: a task holds one part (about `group_rows` queries) and one slice (about `slice_rows` vectors), whatever the keys
look like: both are dealt by a hash of id and place, so neither copies of a vector nor rows of one id meet in one task.
Rows are sent lazily, some thousands at a time. The driver holds numbers for pairs of pivots only, of which there are at
most MOST_PIVOTS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship

ship(__name__)

#: Floats hold integers exactly up to here.
EXACT = float(2**53)
#: Pivots grow with the square root of the number of vectors, up to here. Queries of a part that are scored at once.
MOST_PIVOTS, BLOCK = 1024, 256


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>): floor(256 * component). Rows whose id or vector is null, or that hold a null or non-finite component, go."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).select("id", whole.alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, lengths = np.asarray(column.flatten(), dtype=np.float64), np.diff(np.asarray(column.offsets))
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out, at = np.zeros((len(lengths), dim)), 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T), 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exact; saturated to the range of a long."""
    if q.size and x.size and np.abs(q).max() * np.abs(x).max() * q.shape[1] < EXACT:
        return (q @ x.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape)
    exact = whole(q) @ whole(x).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest id."""
    if len(scores) > 8 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def near_order(between: np.ndarray, cells: list[int]) -> list[int]:
    """Cells in a chain: each is followed by the nearest one left."""
    left, out = set(cells), []
    while left:
        at = min(left) if not out else min(left, key=lambda c: (between[out[-1], c], c))
        out.append(at)
        left.remove(at)
    return out


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Hash of ids and of their places in the batch."""
    h = (ids.astype(np.uint64) + np.arange(len(ids), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(1)


def voronoi_knn_join(queries: DataFrame, data: DataFrame, k: int = 5, n_pivots: int | None = None, group_rows: int = 2048, slice_rows: int = 8192) -> DataFrame:
    """The k data rows of highest inner product for each query: (query_id, rank, vec_id, score).

    queries and data have columns (id long, v array<double> of whole numbers), both free of nulls, as integer_vectors()
    makes them; other columns are ignored, whatever their names. A query never finds a row with its own id. Ties go to
    the smaller id; repeated rows count as rows. Vectors of unequal length compare as if padded with zeros. Empty tables
    give no rows; fewer than k candidates give them all. data should give its rows in the same order each time it is
    read, as written tables do.
    """
    spark = data.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    data, queries = data.select("id", "v"), queries.select("id", "v")
    row = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).first()
    nq = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not row.n or not nq.n:
        return spark.createDataFrame([], schema)
    dim, top, slices = max(row.dim, nq.dim), row.top, -(-row.n // slice_rows)
    n_pivots = n_pivots or min(MOST_PIVOTS, max(16, int(row.n**0.5 / 2)))
    # Pivots are rows of least id hash; a vector that many rows share is one pivot.
    sample = data.orderBy(F.xxhash64("id"), "id").limit(2 * n_pivots).collect()
    chosen = list(dict.fromkeys(tuple(r.v) for r in sample))[:n_pivots]
    raw = np.zeros((len(chosen), dim))
    for i, v in enumerate(chosen):
        raw[i, : len(v)] = v
    pivots = _lift(raw, top)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _lift(_matrix(b.column(1), dim), top)
            d = _distances(x, pivots)
            c = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.astype(np.int32)), pa.array(d[np.arange(len(c)), c])], names=["id", "v", "cell", "d"])

    def query_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            d = _distances(np.hstack([x, np.zeros((len(x), 1))]), pivots)
            c = d.argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.astype(np.int32)), pa.array(d[np.arange(len(c)), c])], names=["id", "v", "cell", "d"])

    shaped = "id long, v array<double>, cell int, d double"
    placed = data.mapInArrow(cells, shaped)
    asked = queries.mapInArrow(query_cells, shaped)

    # Summaries: at most n_pivots rows of k + 1 numbers (one more than k, as a query may meet itself).
    near = Window.partitionBy("cell").orderBy("d")
    least = placed.select("cell", "d").withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list("d")).alias("least"))
    summary = {r.cell: r.least for r in least.collect()}
    reach = {r.cell: (r.n, r.far) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("far")).collect()}

    between = _distances(pivots, pivots)
    slack = 1e-6 * (1 + float(np.abs(pivots).max(initial=0)))
    bound = {}
    for cell, (_, far) in reach.items():
        reachable = np.sort(np.concatenate([far + between[cell, c] + np.array(ds) for c, ds in summary.items()]))
        bound[cell] = float(reachable[k]) if len(reachable) > k else float("inf")  # k + 1 rows lie within it
    # Cells next to each other share a group while their queries fit; a cell with more of them has several parts.
    groups: list[list[int]] = []
    held = 0
    for cell in near_order(between, list(reach)):
        if not groups or held + reach[cell][0] > group_rows:
            groups.append([])
            held = 0
        groups[-1].append(cell)
        held += reach[cell][0]
    parts = np.array([-(-sum(reach[c][0] for c in g) // group_rows) for g in groups])
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    group_of = np.zeros(len(pivots), dtype=np.int64)
    for i, g in enumerate(groups):
        group_of[g] = i
    # A data row at distance d from pivot c can matter to query cell r only if |d(c, r)| - far_r - d <= bound_r.
    edge = np.array([[max(bound[r] + reach[r][1] - between[c, r] for r in g) for g in groups] for c in range(len(pivots))])

    def send_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, group = np.asarray(b.column("id")), group_of[np.asarray(b.column("cell"))]
            pack = first[group] + (_mixed(ids) % parts[group].astype(np.uint64)).astype(np.int64)
            step = max(1, ROWS // max(len(ids), 1))
            for s in range(0, slices, step):
                some = np.arange(s, min(s + step, slices))
                yield from _dealt(b, np.tile(np.arange(len(ids)), len(some)), np.tile(pack, len(some)), np.repeat(some, len(ids)))

    def send_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cell, d = np.asarray(b.column("id")), np.asarray(b.column("cell")), np.asarray(b.column("d"))
            at, group = np.nonzero(edge[cell] + d[:, None] >= -slack)
            slice_no = (_mixed(ids) % np.uint64(slices)).astype(np.int64)[at]
            for part in range(int(parts[group].max(initial=0))):
                some = np.flatnonzero(parts[group] > part)
                yield from _dealt(b, at[some], first[group[some]] + part, slice_no[some])

    def solve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        qid, xid = np.asarray(left["id"]).astype(np.int64), np.asarray(right["id"]).astype(np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        x = _matrix(right["v"], dim) if len(qid) and len(xid) else None
        for start in range(0, len(qid) if x is not None else 0, BLOCK):
            scores = _scores(_matrix(left["v"].slice(start, BLOCK), dim), x)
            for row, q in zip(scores, qid[start : start + BLOCK], strict=True):
                other = np.flatnonzero(xid != q)
                best = other[_best(row[other], xid[other], k)]
                out.append((np.full(len(best), q), xid[best], row[best]))
        parts = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else ([], [], []))]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), parts, strict=True)})

    dealt = "id long, v array<double>, pack int, slice int"
    left, right = asked.mapInArrow(send_queries, dealt), placed.mapInArrow(send_data, dealt)
    partial = left.groupBy("pack", "slice").cogroup(right.groupBy("pack", "slice")).applyInArrow(solve, "query_id long, vec_id long, score long")
    # Spark keeps only the first k of a key in each task before the shuffle (WindowGroupLimit).
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Rows sent at once.
ROWS = 16384


def _dealt(b: pa.RecordBatch, at: np.ndarray, pack: np.ndarray, slice_no: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(at), ROWS):
        take = pa.array(at[i : i + ROWS])
        yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("v").take(take), pa.array(pack[i : i + ROWS].astype(np.int32)), pa.array(slice_no[i : i + ROWS].astype(np.int32))], names=["id", "v", "pack", "slice"])


def knn_query(spark, sf_dir: str) -> DataFrame:
    """op1: every embedding whose vec_id is divisible by 50 against all others."""
    vectors = materialise(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding"), "vectors")
    return voronoi_knn_join(vectors.where(F.col("id") % 50 == 0), vectors)


KNN_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
