"""Removal of repeated byte strings with a distributed sparse suffix array.

A byte goes if a string of `length` bytes that covers it also starts elsewhere. Not all suffixes are sorted, only those
at anchors: of the 64-byte grams of a string of that length, the one of least hash. Equal strings have equal anchors, so
a string can only repeat among the suffixes (and the texts before them) at anchors of the same gram. The strings that
share one anchor overlap and form a segment.

1. A scan finds the segments: place, gram, and a digest of their bytes. About 1 byte in 170 is an anchor.
2. Segments of one digest are equal, so all their strings repeat; this settles the inside of long repeats and copies.
3. Grams with several digests are the ends of repeats. Their segments' bytes are fetched, one for each digest. The
   suffixes at the anchors, and the reversed texts before them, are sorted by deep_shallow_sort(); a string of the
   segment that reaches o bytes before the anchor repeats if another segment is in its class in both suffix arrays:
   the longest common prefix is at least length - o behind and o before. No pairs are formed.
4. The strings found cover spans, which are cut out of each document.

Digests and grams are 64 bits each and count together. Counts are combined before each shuffle, none by a window; the joins
that bring them back to their places can be split where one passage has a third of all places. What settles which bytes:
digests the inside of long repeats and copies, the sort their ends. A gram with more than `most` digests is not collected:
each of its strings is counted by a 128-bit digest instead, which is exact as well. The texts are shuffled once, by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .deep_shallow import common_prefix, deep_shallow_sort

ship(__name__)

GRAM = 64
#: Bytes of text handled at once; positions in them must fit 24 bits.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
LONG = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, dtype=LONG), np.full(n, pow(BASE, -1, 1 << 64), dtype=LONG)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Anchors:
    """Finds the segments of texts."""

    def __init__(self, length: int) -> None:
        self.length, self.width = length, length - GRAM + 1
        self.powers = _powers(BLOCK + length + GRAM)

    def grams(self, data: np.ndarray) -> np.ndarray:
        """Hash of the gram at each position."""
        up, down = self.powers
        sums = np.zeros(len(data) + 1, dtype=LONG)
        np.cumsum((data.astype(LONG) + LONG(1)) * down[: len(data)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * up[: len(data) - GRAM + 1]
        h ^= h >> LONG(29)
        h *= LONG(0xBF58476D1CE4E5B9)
        h ^= h >> LONG(32)
        h *= LONG(0x94D049BB133111EB)
        return h ^ (h >> LONG(29))

    def segments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """First and last string start, anchor and its hash, of each segment of data, in which texts lie at [starts, ends)."""
        if len(data) < self.length:
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, LONG),)
        h, w = self.grams(data), self.width
        key = (h >> LONG(24) << LONG(24)) | np.arange(len(h), dtype=LONG)  # the first of equal grams
        blocks = -(-len(key) // w) + 1
        wide = np.full(blocks * w, ~LONG(0), dtype=LONG)
        wide[: len(key)] = key
        wide = wide.reshape(blocks, w)
        before = np.minimum.accumulate(wide, axis=1).ravel()
        after = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(data) - self.length + 1
        anchor = (np.minimum(after[:n], before[w - 1 : w - 1 + n]) & LONG(0xFFFFFF)).astype(np.int64)
        inside = np.zeros(n + 1, dtype=np.int8)
        for s, e in zip(starts, ends, strict=True):
            if e - s >= self.length:
                inside[s] += 1
                inside[e - self.length + 1] -= 1
        at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        if not len(at):
            return (np.empty(0, np.int64),) * 3 + (np.empty(0, LONG),)
        first = np.flatnonzero(np.concatenate([[True], anchor[at[1:]] != anchor[at[:-1]]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        found = anchor[at[first]]
        return at[first], at[last], found, h[found]


def _find_segments(length: int):
    state: dict[str, Anchors] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = state.get("a") or state.setdefault("a", Anchors(length))
        for b in batches:
            k1, k2 = (np.asarray(b.column(i)).astype(np.int64) for i in (0, 1))
            texts = b.column(2).cast(pa.large_binary())
            for rows in _blocks(texts, length):
                buf = b"".join(t for _, _, t in rows)
                sizes = np.array([len(t) for _, _, t in rows])
                ends = np.cumsum(sizes)
                starts = ends - sizes
                lo, hi, at, gram = finder.segments(np.frombuffer(buf, np.uint8), starts, ends)
                if not len(lo):
                    continue
                digest = np.fromiter((xxhash.xxh3_64_intdigest(buf[s : e + length], a - s) for s, e, a in zip(lo.tolist(), hi.tolist(), at.tolist(), strict=True)), dtype=LONG, count=len(lo))
                owner = np.searchsorted(ends, lo, side="right")
                row = np.array([r for r, _, _ in rows])[owner]
                place = lo - starts[owner] + np.array([o for _, o, _ in rows])[owner]
                packed = (place << 20) | ((hi - lo) << 10) | (at - lo)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], packed, gram.view(np.int64), digest.view(np.int64))], names=["k1", "k2", "place", "gram", "digest"])

    return run


def _blocks(texts: pa.Array, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about BLOCK bytes; long texts come in parts that overlap by length - 1 bytes."""
    out, size = [], 0
    for i, t in enumerate(texts):
        data = t.as_py() or b""
        for offset in range(0, max(len(data) - length + 1, 0), BLOCK - length + 1):
            part = data[offset : offset + BLOCK]
            if out and size + len(part) > BLOCK:
                yield out
                out, size = [], 0
            out.append((i, offset, part))
            size += len(part)
    if out:
        yield out


def _unpack(place: int) -> tuple[int, int, int]:
    """First string start, number of strings less one, anchor less first start."""
    return place >> 20, (place >> 10) & 1023, place & 1023


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def repeated_strings(segments: list[tuple[bytes, int, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each segment (bytes, strings less one, anchor) of one gram and different bytes: ranges of string starts that repeat in another."""
    n = len(segments)
    most, least = [a for _, _, a in segments], [a - extra for _, extra, a in segments]  # bytes before the anchor
    behind, before = [s[a:] for s, _, a in segments], [s[:a][::-1] for s, _, a in segments]
    if n == 2:
        right, left = common_prefix(*behind), common_prefix(*before)
        low, high = max(length - right, *least), min(left, *most)
        return [[(m - high, m - low + 1)] if low <= high else [] for m in most]
    base, top = min(least), max(most)
    o = np.arange(base, top + 1)[:, None]
    code = np.zeros((len(o), n), dtype=np.int64)
    for strings, needed in ((behind, length - o), (before, o)):
        order, prefix = deep_shallow_sort(strings, GRAM if strings is behind else 0)
        classes = np.cumsum(np.array(prefix)[None, :] < needed, axis=1)
        code[:, order] = code[:, order] * (n + 1) + classes
    here = (o >= np.array(least)) & (o <= np.array(most))
    code = np.where(here, code + (o - base) * (n + 2) ** 2, -1 - np.arange(n)[None, :] - n * (o - base))
    _, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    repeats = (counts[where] > 1).reshape(code.shape)
    out = []
    for i in range(n):
        out.append([(most[i] - base - e + 1, most[i] - base - s + 1) for s, e in _runs(repeats[:, i])])
    return out


def _resolve(length: int):
    """Spans of segments that occur once, from rows (gram, k1, k2, place, once, bytes) sorted by gram, key and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[int, int, int, int]] = []

        def close() -> None:
            parts = [_unpack(r[3]) for r in group]
            for r, (lo, _, _), ranges in zip(group, parts, repeated_strings([(r[5], p[1], p[2]) for r, p in zip(group, parts, strict=True)], length), strict=True):
                if r[4]:
                    out.extend((r[1], r[2], lo + s, lo + e - 1 + length) for s, e in ranges)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and row[0] != group[0][0]:
                    close()
                    group.clear()
                if not group or row[1:4] != group[-1][1:4]:  # rows of one key are equal; one of them is enough
                    group.append(row)
            if len(out) > 10_000:
                yield _spans(out)
                out.clear()
        if group:
            close()
        yield _spans(out)

    return run


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["k1", "k2", "start", "end"])


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column("k1").to_pylist(), b.column("k2").to_pylist()
            out: list[tuple] = []
            for i, (text, wanted) in enumerate(zip(b.column("text").cast(pa.large_binary()), b.column("wanted"), strict=True)):
                data = text.as_py()
                for w in wanted.as_py():
                    lo, extra, _ = _unpack(w["place"])
                    out.append((w["gram"], k1[i], k2[i], w["place"], w["once"], data[lo : lo + extra + length]))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))], names=["gram", "k1", "k2", "place", "once", "bytes"])

    return run


def _strings(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, place, once, data in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "place", "once", "bytes")), strict=True):
                lo, extra, _ = _unpack(place)
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[s : s + length]) for s in range(extra + 1)), np.int64).reshape(-1, 2)
                m = extra + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])), pa.array(np.full(m, k1)), pa.array(np.full(m, k2)), pa.array(lo + np.arange(m)), pa.array([once] * m)], names=["h1", "h2", "k1", "k2", "start", "once"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for spans in b.column("spans").to_pylist():
            merged: list[list[int]] = []
            for x in sorted((s["start"], s["end"]) for s in spans):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append(list(x))
            out.append([{"start": s, "end": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["k1", "k2", "spans"])


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with the key (k1, k2) of a row: rows of one key are equal."""
    return docs.withColumns({"k1": F.coalesce(F.col("doc_id"), F.lit(0).cast("long")), "k2": F.xxhash64("doc_id", "text")})


def _sized(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if 0 < rows <= most else df.hint("merge")


def repeated_spans(keyed: DataFrame, length: int = 400, most: int = 1024) -> DataFrame:
    """(k1, k2, spans) for the rows of keyed (doc_id, text, k1, k2) that have bytes covered by strings of `length` bytes that start more than once: merged [start, end) in bytes."""
    if not GRAM < length <= 1023:
        raise ValueError(f"length must be over {GRAM} and at most 1023 bytes")
    found = keyed.where(F.octet_length("text") >= length).select("k1", "k2", "text").mapInArrow(_find_segments(length), "k1 long, k2 long, place long, gram long, digest long")
    found = materialise(found, "segments")
    # Grams that occur twice, with partial sums first; only their segments go on. These joins shuffle at any size, so what is measured on little data holds for much.
    grams = found.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1")
    grams = grams.select("g", (F.col("low") != F.col("high")).alias("several"))
    again = materialise(found.join(grams.hint("merge"), F.col("gram") == F.col("g")).drop("g"), "repeated")
    same = F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "place"))
    alike = materialise(again.where("several").groupBy("gram", "digest").agg(*same), "digests")

    # All strings of a segment that occurs more than once repeat.
    twice = alike.where("n > 1").select(F.col("gram").alias("g"), F.col("digest").alias("d"))
    among = again.where("several").join(twice.hint("merge"), (F.col("gram") == F.col("g")) & (F.col("digest") == F.col("d"))).drop("g", "d")
    lo = F.shiftright("place", 20)
    spans = again.where("not several").union(among).select("k1", "k2", lo.alias("start"), (lo + F.shiftright("place", 10).bitwiseAND(F.lit(1023)) + length).alias("end"))

    # Segments of a gram that has several digests are compared, one of each digest.
    kinds = alike.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("kinds"))
    ends = alike.join(kinds, F.col("gram") == F.col("g")).select("k1", "k2", F.struct("gram", "place", (F.col("n") == 1).alias("once"), "kinds").alias("w"))
    wanted = materialise(ends.groupBy("k1", "k2").agg(F.collect_list("w").alias("wanted")), "wanted")
    # The same rows in the same columns as remove_repeats() joins, and no table written between, so that the texts are shuffled once for all uses.
    fetched = keyed.join(wanted.hint("merge"), ["k1", "k2"])
    few, many = (F.filter("wanted", lambda w: w["kinds"] <= most), F.filter("wanted", lambda w: w["kinds"] > most))
    shape = "gram long, k1 long, k2 long, place long, once boolean, bytes binary"
    if not wanted.isEmpty():
        cut = fetched.withColumn("wanted", few).mapInArrow(_cut(length), shape)
        spans = spans.union(cut.repartition("gram").sortWithinPartitions("gram", "k1", "k2", "place").mapInArrow(_resolve(length), "k1 long, k2 long, start long, end long"))
    if not wanted.where(F.exists("wanted", lambda w: w["kinds"] > most)).isEmpty():
        crowd = fetched.withColumn("wanted", many).mapInArrow(_cut(length), shape).distinct()
        strings = crowd.mapInArrow(_strings(length), "h1 long, h2 long, k1 long, k2 long, start long, once boolean")
        more = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
        spans = spans.union(strings.where("once").join(more, ["h1", "h2"]).select("k1", "k2", "start", (F.col("start") + length).alias("end")))
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return spans.mapInArrow(_merge, "k1 long, k2 long, spans array<struct<start:long,end:long>>")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, size, gone, spans, digest = [], [], [], [], []
        for text, cuts in zip(b.column("text").cast(pa.large_binary()), b.column("spans").to_pylist(), strict=True):
            data, cuts = text.as_py() or b"", cuts or []
            edges = [0, *(x for c in cuts for x in (c["start"], c["end"])), len(data)]
            left = b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))
            texts.append(left)
            size.append(len(data))
            gone.append(len(data) - len(left))
            spans.append(len(cuts))
            digest.append(hashlib.sha256(left).hexdigest())
        kept = [b.column(c) for c in b.schema.names if c not in ("text", "spans")]
        names = [c for c in b.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], names=[*names, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, length: int = 400, most: int = 1024, broadcast_rows: int = 0) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs (doc_id, text).

    Texts are UTF-8 bytes; a null text is empty; matches never cross rows. kept is what is left, which need not be
    valid UTF-8, as repeats may start within a character. Rows that repeat are each other's copies. A null doc_id keeps
    its row. Other columns are ignored. An empty table gives an empty one. broadcast_rows: up to how many spans may be
    broadcast instead of shuffling the texts; by default none, so the plan is the same at every size.
    """
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    spans = repeated_spans(keyed, length, most)
    if broadcast_rows:
        spans = materialise(spans, "spans")
        spans = _sized(spans, spans.agg(F.sum(F.size("spans"))).first()[0] or 0, broadcast_rows)
    joined = keyed.join(spans.hint("merge") if not broadcast_rows else spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_without, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def suffix_query(spark, sf_dir: str) -> DataFrame:
    """op2: what is left of every document without strings of 400 bytes that start more than once."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
