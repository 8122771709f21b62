"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary [23, 12]
Golay code (the missing bits are zero). A word's keys are the indices of the codewords that it or a word one bit away
decodes to: one to a few. Words two or fewer bits apart share a key, since they share a word one bit from both. Two
fingerprints that differ in two bits or fewer agree wholly on at least one of three segments (pigeonhole) and share a
key of each other one. So (segment, its bits, key of the next segment) meets every linked pair; meetings are verified.

Equal fingerprints are one row from the start. Fingerprints that meet are compared where they meet, and only a star
per group goes on, never all pairs. A meeting place with more than `most` different fingerprints is not collected:
its members are linked through the words one bit away from them, which is exact and stays in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST, materialise, ship, within
from .components import connected_components
from .shingle_sets import majority, similar_groups

ship(__name__)

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: Lowest bit and width of each segment of a fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Of 128 bits, how many may differ between fingerprints of texts to be compared: at a similarity of 0.8 by 5-word shingles about 19 do, with a deviation of 4; between others 64.
RADIUS = 30


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word modulo the generator."""
    out = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        out ^= ((out >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return out


def _leaders() -> np.ndarray:
    """The error pattern of weight 3 or less for each of the 2048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], dtype=np.uint32)
    out = np.zeros(2048, dtype=np.uint32)
    out[_syndromes(errors)] = errors
    return out


def golay_keys(words: np.ndarray, width: int = 23) -> np.ndarray:
    """For each word a row of 1 + width codeword indices: its own and those of the words one bit away; repeats are -1."""
    flips = np.array([0, *(1 << b for b in range(width))], dtype=np.uint32)
    near = words.astype(np.uint32)[:, None] ^ flips[None, :]
    index = ((near ^ _leaders()[_syndromes(near)]) >> np.uint32(11)).astype(np.int64)
    index.sort(axis=1)
    index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
    return index


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of a text's word shingles by XXH64 with seed 42; no words give 0."""
    words = text.lower().split()  # on bytes: A-Z only; blanks are x20 and x09 to x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < size:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)), dtype="<u8", count=len(words) - size + 1)
    return majority(hashes)


def _utf8(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t, size) for t in _utf8(b.column(1))), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _meeting_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 16384):
            fp = np.asarray(b.column(0).slice(start, 16384)).astype(np.int64).view(np.uint64)
            parts = [((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
            for i in range(3):
                j = (i + 1) % 3
                index = golay_keys(parts[j], SEGMENTS[j][1])
                at, col = np.nonzero(index >= 0)
                key = (np.int64(i) << np.int64(40)) | (parts[i][at] << np.int64(12)) | index[at, col]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at].view(np.int64))], names=["key", "fp"])


def _stars(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the least one that it reaches within the group."""
    u = np.unique(fps).view(np.uint64)
    label = np.arange(len(u))
    near = [np.flatnonzero(np.bitwise_count(u ^ x) <= distance) for x in u]
    while True:
        least = np.array([label[n].min() for n in near])
        least = least[least]
        if (least == label).all():
            break
        label = least
    far = label != np.arange(len(u))
    return u[far].view(np.int64), u[label[far]].view(np.int64)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0, *(1 << b for b in range(64))], dtype=np.uint64)
    for b in batches:
        for start in range(0, b.num_rows, 4096):
            fp = np.asarray(b.column(0).slice(start, 4096)).astype(np.int64).view(np.uint64)
            near = fp[:, None] ^ flips[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, 65).view(np.int64)), pa.array(near.ravel().view(np.int64))], names=["fp", "near"])


def near_links(distinct: DataFrame, most: int = 2048) -> DataFrame:
    """(u, v) edges between different fingerprints fp that join all those linked by 2 or fewer differing bits, and no others."""
    keyed = materialise(distinct.select("fp").mapInArrow(_meeting_keys, "key long, fp long"), "keys")
    # Counted with partial sums and joined back: a join can be split at a hot key, which a window would put into one task.
    counts = keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = materialise(keyed.join(counts.hint("merge"), F.col("key") == F.col("k")).drop("k"), "meetings")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_stars(np.asarray(x.values).astype(np.int64), 2) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found] or [np.empty(0, np.int64)]), pa.int64()) for i in (0, 1)], names=["u", "v"])

    usual = keyed.where(F.col("n") <= most).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(solve, "u long, v long")
    # Any two fingerprints one bit from the same word are two bits apart at most, so these links need no check.
    crowd = keyed.where(F.col("n") > most).select("fp").distinct().mapInArrow(_neighbours, "fp long, near long")
    least = crowd.groupBy("near").agg(F.min("fp").alias("v"))
    rest = crowd.join(least, "near").select(F.col("fp").alias("u"), "v").where("u <> v")
    return usual.union(rest).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 2048) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    Texts are lower-cased (A-Z), cut into words at ASCII blanks and into shingles of `size` words, repeats included; a
    shorter text is one shingle; a text without words, an empty or a null text has fingerprint zero and is linked like
    any other. Fingerprints link at 2 or fewer differing bits; component_id is the smallest id reachable. Repeated rows
    each get their row. A null id keeps its row and never names a component unless all of its ids are null. Texts of any
    length are read whole. Ties: a bit set in just half of the shingles is 0. Other columns are ignored, whatever their
    names. An empty table gives an empty one.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = connected_components(near_links(distinct, most))
    rooted = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(least, "root").select(F.col("fp").alias("f"), "component_id"), "components")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, F.col("fp") == F.col("f")).select("doc_id", shown.alias("fingerprint"), "component_id")


def _pair_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, print, more): for each two segments of print, each pair of their Golay keys."""
    for b in batches:
        for start in range(0, b.num_rows, 2048):
            part = b.slice(start, 2048)
            fp, more = (np.asarray(part.column(i)).astype(np.int64) for i in (0, 1))
            index = [-np.sort(-golay_keys((fp.view(np.uint64) >> np.uint64(low)) & np.uint64((1 << width) - 1), width), axis=1) for low, width in SEGMENTS]
            index = [x[:, : (x >= 0).sum(axis=1).max()] for x in index]  # a word has a few keys; they come first now
            for i, j in combinations(range(3), 2):
                at, x, y = np.nonzero((index[i] >= 0)[:, :, None] & (index[j] >= 0)[:, None, :])
                key = (np.int64(i + j) << np.int64(24)) | (index[i][at, x] << np.int64(12)) | index[j][at, y]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at]), pa.array(more[at])], names=["key", "print", "more"])


def _nearest(radius: int):
    """(u, v, bits): for each fingerprint of a group the nearest one before it, if the two differ in `radius` bits of 128 or fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            rows, lengths = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
            u, w = (np.asarray(c).astype(np.int64).view(np.uint64) for c in (rows.field(0), rows.field(1)))
            place = np.arange(len(u)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            best, of = np.full(len(u), 129), np.zeros(len(u), dtype=np.int64)
            at = np.flatnonzero(place >= 1)
            for k in range(1, int(lengths.max(initial=0))):
                at = at[place[at] >= k]
                bits = np.bitwise_count(u[at] ^ u[at - k]).astype(np.int64) + np.bitwise_count(w[at] ^ w[at - k])
                less = bits < best[at]
                best[at[less]], of[at[less]] = bits[less], at[less] - k
            near = np.flatnonzero(best <= radius)
            yield pa.RecordBatch.from_arrays([pa.array(u[near].view(np.int64)), pa.array(u[of[near]].view(np.int64)), pa.array(best[near])], names=["u", "v", "bits"])

    return run


def near_pairs(sets: DataFrame, radius: int = RADIUS, most: int = 256) -> DataFrame:
    """(u, v): for each of the different sets (fp, print, more) its nearest by fingerprint among those that it meets, if there is one.

    print and more are 64-bit fingerprints by two hashes. Fingerprints meet if two of the three segments of print share a Golay
    key; two sets go on as a pair if they differ in `radius` bits of the 128 or fewer. Of a group with more than `most`
    fingerprints each is compared with one of them only. These are links to be verified and no whole search.
    """
    prints = sets.groupBy("print").agg(F.min(F.struct("fp", "more")).alias("least")).select("print", F.col("least.fp").alias("least"), F.col("least.more").alias("more"))
    prints = materialise(prints, "prints")
    keyed = prints.select("print", "more").repartition(1 + prints.count() // 8192, "print").mapInArrow(_pair_keys, "key long, print long, more long")
    # Counted with partial sums and joined back: a join can be split at a hot key. The usual groups are collected where they are joined.
    counts = materialise(keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "print-keys")
    met = keyed.join(counts.where(F.col("m") <= most).select("k").hint("merge"), F.col("key") == F.col("k"))
    group = F.sort_array(F.collect_list(F.struct("print", "more"))).alias("group")
    near = met.groupBy("key").agg(group).select("group").mapInArrow(_nearest(radius), "u long, v long, bits long")
    crowded = counts.where(F.col("m") > most).select("k")
    if not crowded.isEmpty():
        crowd = keyed.join(within(materialise(crowded, "print-crowded"), BROADCAST), F.col("key") == F.col("k")).drop("k")
        hub = crowd.groupBy("key").agg(F.min("print").alias("hub"))
        hub = hub.join(prints.select(F.col("print").alias("hub"), F.col("more").alias("hub_more")), "hub").select(F.col("key").alias("k"), "hub", "hub_more")
        bits = F.bit_count(F.col("print").bitwiseXOR(F.col("hub"))) + F.bit_count(F.col("more").bitwiseXOR(F.col("hub_more")))
        to_hub = crowd.join(hub, F.col("key") == F.col("k")).where((F.col("print") != F.col("hub")) & (bits <= radius))
        near = near.union(to_hub.select(F.col("print").alias("u"), F.col("hub").alias("v"), bits.cast("long").alias("bits")))
    near = near.groupBy("u").agg(F.min(F.struct("bits", "v")).alias("to")).select("u", F.col("to.v").alias("v"))
    one, two = (prints.select(F.col("print").alias(p), F.col("least").alias(f)) for p, f in (("u", "f"), ("v", "t")))
    apart = near.join(one, "u").join(two, "v").select(F.least("f", "t").alias("u"), F.greatest("f", "t").alias("v"))
    # Different sets of one fingerprint are tried with the least of them.
    same = sets.join(prints.select("print", "least"), "print").where("fp <> least").select(F.col("least").alias("u"), F.col("fp").alias("v"))
    return apart.union(same)


def keep_one(docs: DataFrame, size: int = 5, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of docs (doc_id, text), one of each group: that of the smallest id. Of rows with one id one stays. Rows with a null id cannot be told apart: they stay if any of them is in a group without an id.

    Groups are those of similar_groups(): near_pairs() finds the links through SimHash fingerprints and Golay keys, each is
    verified on the whole shingle sets, and an exact search adds the links between groups that fingerprints have missed.
    """
    groups = materialise(similar_groups(docs, size, meetings=near_pairs), "groups")
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = materialise(kept, "kept")
    n, repeats = kept.agg(F.count(F.lit(1)), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n")))).first()
    ids = kept.select(F.col("doc_id").alias("_id"))
    out = docs.join(F.broadcast(ids) if n <= broadcast_rows else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if repeats and repeats > 1:
        out = out.where("doc_id is not null").dropDuplicates(["doc_id"]).union(out.where("doc_id is null"))
    return out


def simhash_query(spark, sf_dir: str) -> DataFrame:
    """op3: near-duplicate components of all documents."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
