"""Near-duplicates by the Jaccard similarity of word shingles, exactly.

Each text is its set of shingle hashes; equal sets are one from the start. The caller may name pairs to try first, found by
the sets' fingerprints; those that are similar join their sets, and the search below is for the links between sets that are
still apart. All sets are ordered alike: shingles that a sample of texts shows to be common come last, the others by their
hash. Of two sets with n and m members that are as similar as asked, the first few members in that order (the prefix,
n - ceil(n * similarity) + 1 of them) meet in at least one, so joining prefixes finds every pair (the sample only sets the
order, and any order is right). A shingle whose sets are all in one component goes. The shingles where a set meets others
are then ordered by how many sets meet there, the rarest first. Similar sets share a number of them that follows from
their lengths, so the first one that they share has that many left in both, itself included: sets meet only where enough
are left. The similarity of those pairs is counted on the whole sets.

A shingle in the prefixes of more than `most` sets is not joined with itself at once: its sets are first compared with a
few chosen ones, and then only sets that are still in different components meet, so a large group of near copies costs
a few comparisons a member.

Whole sets are not written: one scan makes digest, fingerprint and prefix of each, and the members of the sets that are
compared are made again from their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST, materialise, ship, within
from .components import connected_components

ship(__name__)

#: Two texts are near-duplicates if they share at least SHARED / OF of their different shingles.
SHARED, OF = 4, 5
#: The sample that sets the order has about so many sets; a shingle in COMMON of them or more is common, MOST of these at most.
SAMPLE, COMMON, MOST = 20_000, 2, 1 << 20


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted different hashes (XXH64, seed 42) of a text's word shingles; a shorter text is one shingle, no words are none."""
    words = text.lower().split()  # on bytes: A-Z only; blanks are x20 and x09 to x0D
    if not words:
        return np.empty(0, dtype=np.int64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, 42)], dtype=np.uint64).view(np.int64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.unique(np.fromiter((h(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)), dtype=np.uint64, count=len(words) - size + 1).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes; 0 for none."""
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += part.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _second(s: np.ndarray) -> np.ndarray:
    """Other 64-bit hashes of the same shingles."""
    h = s.view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes())


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves, sorted, of shingles that are common in a sample of the texts, and in how many texts of it they are (255 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                found = [shingles(t.as_py() or b"", size) for t in b.column(0).slice(start, 256).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["key"])

    every = max(1, docs.count() // SAMPLE)
    counted = docs.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(run, "key long").groupBy(F.shiftright("key", 32).cast("int").alias("key")).count().where(F.col("count") >= COMMON)
    # Six bytes a shingle reach the driver and the workers. Shingles of one half count together, which is an order too.
    rows = counted.orderBy(F.desc("count"), "key").limit(MOST).select("key", F.least("count", F.lit(255)).cast("short").alias("count")).toArrow()
    keys, counts = rows["key"].to_numpy(), rows["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.uint8)


def _row(docs: DataFrame) -> DataFrame:
    """docs with the number `at` of a row: rows of one number are equal."""
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("at"), "text")


def shingle_sets(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int = 5) -> DataFrame:
    """(doc_id, at, fp, print, more, n, prefix) for docs (doc_id, text): fp is a 64-bit digest of the set, print and more are its SimHash fingerprints by two hashes, n counts its members. A null text counts as empty."""
    keys, counts = common

    def first(s: np.ndarray) -> np.ndarray:
        n = len(s)
        p = n - (SHARED * n + OF - 1) // OF + 1
        if n and len(keys):
            half = (s >> np.int64(32)).astype(np.int32)
            at = np.minimum(np.searchsorted(keys, half), len(keys) - 1)
            s = s[np.argsort(np.where(keys[at] == half, counts[at], 0), kind="stable")]
        return s[:p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                rows = []
                for t in part.column(2).cast(pa.large_binary()):
                    s = shingles(t.as_py() or b"", size)
                    rows.append((_digest(s), majority(s.view(np.uint64)), majority(_second(s)), len(s), first(s)))
                longs = [pa.array(np.array([r[k] for r in rows], dtype=np.uint64).view(np.int64)) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *longs, _lists([r[4] for r in rows])], names=["doc_id", "at", "fp", "print", "more", "n", "prefix"])

    return _row(docs).mapInArrow(run, "doc_id long, at long, fp long, print long, more long, n long, prefix array<long>")


def _possible(n: Column, m: Column, met: Column) -> Column:
    """Whether sets of n and m members can be similar if their prefixes meet in `met` members at most."""
    rest = F.ceil(F.greatest(n, m) * SHARED / OF) - 1  # members behind the prefix of the longer set
    return (F.least(n, m) * OF >= F.greatest(n, m) * SHARED) & ((met + rest) * (SHARED + OF) >= (n + m) * SHARED)


def _similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, size: int) -> DataFrame:
    """Those (u, v) whose sets are similar. The members are made from the text of one row of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                found = [shingles(t.as_py() or b"", size) for t in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(found)], names=["fp", "members"])

    pairs = materialise(pairs, "set-pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()
    asked = materialise(sets.join(asked, "fp", "left_semi").select("fp", F.col("at").alias("of")), "set-asked")
    rows = _row(docs).join(within(asked, BROADCAST), F.col("at") == F.col("of")).select("fp", "text")
    members = materialise(rows.mapInArrow(run, "fp long, members array<long>"), "set-members")
    one = members.select(F.col("fp").alias("u"), F.col("members").alias("a"))
    two = members.select(F.col("fp").alias("v"), F.col("members").alias("b"))
    both = pairs.select("u", "v").join(one, "u").join(two, "v")
    return materialise(both.where(F.size(F.array_intersect("a", "b")) * (SHARED + OF) >= (F.size("a") + F.size("b")) * SHARED).select("u", "v").distinct(), "set-links")


def _meeting(left: DataFrame) -> DataFrame:
    """(u, v), u < v, for sets of different roots in left (key, fp, n, rest, root) and each key where they meet with enough keys left of either."""
    cols = ["fp", "n", "rest", "root"]
    a = left.select("key", *(F.col(c).alias(f"{c}_a") for c in cols))
    b = left.select(F.col("key").alias("key_b"), *(F.col(c).alias(f"{c}_b") for c in cols))
    possible = _possible(F.col("n_a"), F.col("n_b"), F.least("rest_a", "rest_b"))
    met = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("fp_a") < F.col("fp_b")) & possible & (F.col("root_a") != F.col("root_b")))
    return met.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v"))


def _rest(marked: DataFrame, links: DataFrame | None, verify: Callable[[DataFrame], DataFrame], most: int, hubs: int = 8) -> DataFrame:
    """(u, v) edges between different sets fp that, with links, join all those as similar as asked, and no others."""
    sets = marked.select("fp", "n", "prefix", F.col("fp").alias("root"))
    if links is not None:
        comp = materialise(connected_components(links), "set-components")
        sets = sets.drop("root").join(within(comp, BROADCAST), F.col("fp") == F.col("node"), "left").select("fp", "n", "prefix", F.coalesce("root", "fp").alias("root"))
    prefixes = sets.select("fp", "n", "root", F.explode("prefix").alias("key"))
    # Counted with partial sums and joined back: a join can be split at a hot key, which a window would put into one task.
    counts = prefixes.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("k", "m")
    # Rows of equal sets become one here. rest counts a set's keys from this one on, the rarest first.
    met = prefixes.join(counts.hint("merge"), F.col("key") == F.col("k")).drop("k").distinct()
    met = materialise(met.withColumn("rest", F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("m"), F.desc("key")))), "set-meetings")
    pairs = _meeting(met.where(F.col("m") <= most)).distinct()
    crowd = met.where(F.col("m") > most)
    if crowd.isEmpty():
        return verify(pairs)
    # The crowded keys are a set's last ones: h of them.
    crowded = crowd.groupBy("fp").agg(F.count(F.lit(1)).alias("h"))
    crowd = materialise(crowd.join(crowded, "fp").select("key", "fp", "n", "h", "rest", "root"), "set-crowds")
    hub = crowd.groupBy("key").agg(F.min_by(F.struct("fp", "n", "h", "root"), F.xxhash64("fp", "key")).alias("hub"))
    few = crowd.withColumn("r", F.row_number().over(Window.partitionBy("fp").orderBy(F.xxhash64("key")))).where(F.col("r") <= hubs)
    tried = few.join(hub, "key").where((F.col("root") != F.col("hub.root")) & _possible(F.col("n"), F.col("hub.n"), F.least("h", "hub.h")))
    tried = tried.select(F.least("fp", "hub.fp").alias("u"), F.greatest("fp", "hub.fp").alias("v"))
    tried = materialise(pairs.union(tried).distinct(), "set-tried")
    found = verify(tried)
    # What still lies in different components after that is compared in full.
    comp = connected_components(found if links is None else found.union(links))
    rooted = crowd.drop("root", "h").join(comp, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", "rest", F.coalesce("root", "fp").alias("root"))
    split = rooted.groupBy("key").agg((F.min("root") != F.max("root")).alias("split")).where("split").select("key")
    left = materialise(rooted.join(split, "key", "left_semi"), "set-left")
    return found.union(verify(_meeting(left).distinct().join(tried, ["u", "v"], "left_anti")))


def similar_groups(docs: DataFrame, size: int = 5, most: int = 32, meetings: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, component_id), a row for each row of docs (doc_id, text).

    Texts are lower-cased (A-Z) and cut into words at ASCII blanks; sets of shingles of `size` words link at a Jaccard
    similarity of SHARED / OF or more. A shorter text is one shingle; texts without words, empty and null ones are alike.
    component_id is the smallest id reachable; a null id never names a component unless all of its ids are null.
    meetings takes the different sets (fp, print, more, n) and gives the pairs (u, v) of fp to try first; the result is the
    same with any pairs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = materialise(shingle_sets(docs, _common(docs, size), size), "shingle-sets")
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("row")
    sets = marked.groupBy("fp").agg(row, *(F.first(c).alias(c) for c in ("print", "more", "n")))
    sets = materialise(sets.select("fp", "print", "more", "n", F.col("row.doc_id").alias("least"), F.col("row.at").alias("at")), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, docs, sets, size)

    links = verify(meetings(sets.select("fp", "print", "more", "n").where("n > 0"))) if meetings else None
    rest = _rest(marked, links, verify, most)
    comp = connected_components(rest if links is None else links.union(rest))
    rooted = materialise(sets.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(named, "root").select(F.col("fp").alias("f"), "component_id"), "components")
    return marked.select("doc_id", "fp").join(named, F.col("fp") == F.col("f")).select("doc_id", "component_id")
