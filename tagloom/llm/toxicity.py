"""Toxicity by class-conditional Kneser-Ney models.

Two character n-gram models, one of the words of toxic documents and one of those of ordinary ones, give each word a
length-normalised log-likelihood under either class. Both are interpolated Kneser-Ney models: the highest order from
counts, lower orders from continuation counts. Up to `shared` characters of context the counts of both classes are
pooled, so a rare expression that one class has not seen falls back on the same distribution in both and says nothing.
A document's evidence is the difference of its length-normalised log-likelihoods under both classes: of the whole text,
and of the words where it is greatest, as a few words can make a long text toxic. A logistic curve, fitted on documents
that the models have not seen, turns it into a score.

The fit sees a bounded sample: `per_class` training documents of each class, those of least hash of doc_id; half of them
are counted, all their words, and half set the curve. Everything else covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_hashes, materialise, remainder, ship
from .wordscores import Lookup, WordScores, chunks, mixed, padded, prefix_hashes

ship(__name__)

#: Bytes of a word that are scored at once; longer words are scored in parts.
WIDTH = 30
FEATURES = 7
DISCOUNT = 0.75
#: Count cutoff of the higher orders, as usual in n-gram models: grams longer than this need two documents of the sample.
SINGLES = 3
#: Added to the length in a context's hash, which keeps it apart from a gram's.
CONTEXT = 1 << 12


def word_parts(text: bytes) -> list[bytes]:
    """Words in lower case without ASCII punctuation at their ends, as ^word$; long ones in parts."""
    words = [b"^" + w + b"$" for w in (x.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for x in text.lower().split()) if w]
    if max(map(len, words), default=0) <= WIDTH:
        return words
    return [w[i : i + WIDTH] for w in words for i in range(0, len(w), WIDTH)]


class ClassModels:
    """log p(next byte | context) of both classes, as n-gram tables with back-off weights."""

    def __init__(self, words: list[bytes], counts: np.ndarray, order: int = 9, shared: int = 2) -> None:
        """counts: for each word the documents of each class (ordinary, toxic) that hold it."""
        self.order = order
        matrix, lengths = padded(words, max(map(len, words)))
        prefix, powers = prefix_hashes(matrix)
        grams: dict[int, tuple[np.ndarray, ...]] = {}
        for n in range(1, order + 1):
            ends = range(max(n, 2), matrix.shape[1] + 1)  # the first byte, ^, is context only
            at = [np.flatnonzero(lengths >= end).astype(np.int32) for end in ends]
            if not sum(map(len, at)):
                break
            gram = np.concatenate([_hash(prefix[rows], powers, end - n, end) for end, rows in zip(ends, at, strict=True)])
            rows, end = np.concatenate(at), np.repeat(np.array(ends, dtype=np.int16), [len(r) for r in at])
            gram, first, where = np.unique(gram, return_index=True, return_inverse=True)
            count = np.column_stack([np.bincount(where, counts[rows, c], len(gram)) for c in (0, 1)])
            if n > SINGLES:  # long grams of one document say more about it than about its class
                some = count.sum(1) >= 2
                gram, first, count = gram[some], first[some], count[some]
            rows, start, end = rows[first], end[first].astype(np.int64) - n, end[first].astype(np.int64)
            # Hashes of the gram without its last byte and without its first.
            context = mixed(prefix[rows, end - 1] - prefix[rows, start] * powers[n - 1], n - 1 + CONTEXT)
            suffix = mixed(prefix[rows, end] - prefix[rows, start + 1] * powers[n - 1], n - 1)
            if not len(gram):
                break
            grams[n] = gram, context, suffix, start == 0, count
        tables, lower = [], None
        for n, (gram, context, suffix, begins, count) in grams.items():
            if n + 1 in grams:  # lower orders count in how many contexts a gram continues; a word's start has none before it
                longer, seen = grams[n + 1][2], grams[n + 1][4] > 0
                at = np.searchsorted(gram, longer)
                kinds = np.column_stack([np.bincount(at, seen[:, c], len(gram)) for c in (0, 1)])
                count = np.where(begins[:, None], count, kinds)
            if n <= shared + 1:
                count = np.repeat(count.sum(1, keepdims=True), 2, axis=1)
            contexts, where = np.unique(context, return_inverse=True)
            total = np.column_stack([np.bincount(where, count[:, c], len(contexts)) for c in (0, 1)])
            freed = np.column_stack([np.bincount(where, np.minimum(count[:, c], DISCOUNT), len(contexts)) for c in (0, 1)])
            back = np.where(total > 0, freed / np.maximum(total, 1e-9), 1.0)
            below = np.full(count.shape, 1 / 256) if lower is None else lower[1][np.searchsorted(lower[0], suffix)]
            prob = np.where(total[where] > 0, np.maximum(count - DISCOUNT, 0) / np.maximum(total[where], 1e-9), 0) + back[where] * below
            # Only the difference of the classes' logarithms counts from here on.
            tables.append((gram, np.diff(np.log(prob))[:, 0], contexts, np.diff(np.log(np.maximum(back, 1e-12)))[:, 0]))
            lower = gram, prob
        self.keys, self.gains, self.backs, self.falls = (np.concatenate(c).astype(kind) for c, kind in zip(zip(*tables, strict=True), (np.uint64, np.float32, np.uint64, np.float32), strict=True))

    @staticmethod
    def read(order: int, keys: bytes, gains: bytes, backs: bytes, falls: bytes) -> ClassModels:
        """Models from the bytes of their tables."""
        out = ClassModels.__new__(ClassModels)
        out.order, out.keys, out.backs = order, np.frombuffer(keys, np.uint64), np.frombuffer(backs, np.uint64)
        out.gains, out.falls = np.frombuffer(gains, np.float32), np.frombuffer(falls, np.float32)
        return out

    def scorer(self) -> WordScores:
        """Two numbers a word: log p(toxic) - log p(ordinary), in total and as the mean over its bytes."""
        grams, backs = Lookup(self.keys), Lookup(self.backs)

        def score(words: list[bytes]) -> np.ndarray:
            matrix, lengths = padded(words, max(map(len, words)))
            prefix, powers = prefix_hashes(matrix)
            ratio = np.zeros(len(words))
            for i in range(1, matrix.shape[1]):
                rows = np.flatnonzero(lengths > i)
                for start in range(max(0, i + 1 - self.order), i + 1):  # the longest gram first, then down the failure arcs
                    if not len(rows):
                        break
                    at = prefix[rows]
                    found = grams(_hash(at, powers, start, i + 1))
                    hit = found >= 0
                    ratio[rows[hit]] += self.gains[found[hit]]
                    rows, at = rows[~hit], at[~hit]
                    context = backs(_hash(at, powers, start, i, CONTEXT))
                    known = context >= 0
                    ratio[rows[known]] += self.falls[context[known]]
            return np.column_stack([ratio, ratio / np.maximum(lengths - 1, 1)])

        return WordScores(score, 2)


def _hash(prefix: np.ndarray, powers: np.ndarray, start: int, end: int, salt: int = 0) -> np.ndarray:
    return mixed(prefix[:, end] - prefix[:, start] * powers[end - start], end - start + salt)


def evidence(texts: list[bytes], scorer: WordScores) -> np.ndarray:
    """For each text the log-ratio per byte of the whole, the three greatest ones of its different words, and the three greatest of a word in total."""
    out = np.zeros((len(texts), FEATURES))
    for a, b in chunks(texts):
        parts = [word_parts(t) for t in texts[a:b]]
        flat = [w for p in parts for w in p]
        if not flat:
            continue
        index = scorer(flat)
        sizes = np.fromiter(map(len, flat), np.int64, len(flat)) - 1
        end = 0
        for k, p in enumerate(parts):
            if p:
                all_, own = index[end : end + len(p)], np.unique(index[end : end + len(p)])
                total, each = scorer.rows[all_, 0], scorer.rows[own]
                top = np.sort(each, axis=0)[::-1][:3]
                out[a + k, 0] = total.sum(dtype=np.float64) / max(sizes[end : end + len(p)].sum(), 1)
                out[a + k, 1 : 1 + len(top)] = top[:, 1]
                out[a + k, 4 : 4 + len(top)] = top[:, 0]
            end += len(p)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, scale and weights (bias last) of a ridge logistic regression, by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w += np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
    return mean, scale, w


class ToxicityModel:
    """A broadcast of the tables of ClassModels, and the logistic curve; None for either if there is nothing to learn from."""

    def __init__(self, models: Broadcast | None, curve: tuple | None) -> None:
        self.models, self.curve = models, curve

    def score(self, texts: list[bytes], scorer: WordScores | None) -> np.ndarray:
        """0 to 1; without a model all texts score 0."""
        if self.curve is None or scorer is None:
            return np.zeros(len(texts))
        mean, scale, w = self.curve
        x = (evidence(texts, scorer) - mean) / scale
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def _texts(column: pa.Array) -> list[bytes]:
    return [t.as_py() or b"" for t in column.cast(pa.large_binary())]


def _count_grams(order: int):
    """The models of the words of a sample, made in one task: the driver only gets their tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.Table.from_batches(batches, pa.schema([("w", pa.binary()), ("o", pa.int64()), ("t", pa.int64())]))
        counts = np.column_stack([words[c].to_numpy().astype(np.float64) for c in ("o", "t")])
        if len(counts) and counts.sum(axis=0).all():
            m = ClassModels(words["w"].to_pylist(), counts, order)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.keys, m.gains, m.backs, m.falls)], names=["keys", "gains", "backs", "falls"])

    return run


def fit(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = 2400, order: int = 9) -> ToxicityModel:
    """Fit on labelled rows (doc_id, toxic) for which train holds and docs (doc_id, text). A doc_id that several labels name counts as toxic if one says so; one that several rows have stands for its least text."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = least_hashes(named, "toxic", "doc_id", per_class).withColumn("counts", F.xxhash64("doc_id", F.lit(7)) % 2 != 0)
    chosen = F.broadcast(materialise(chosen, "sample"))  # 2 * per_class rows of two numbers
    sample = docs.join(chosen, "doc_id").groupBy("doc_id", "toxic", "counts").agg(F.min("text").alias("text"))
    sample = materialise(sample, "sample-texts")

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b.column(0))
            rows = [(w, y) for t, y in zip(texts, b.column(1).to_pylist(), strict=True) for w in set(word_parts(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], names=["w", "toxic"])

    found = sample.where("counts").select("text", "toxic").mapInArrow(distinct_words, "w binary, toxic int")
    words = found.groupBy("w").agg(F.sum(1 - F.col("toxic")).alias("o"), F.sum("toxic").alias("t")).orderBy("w")
    made = words.coalesce(1).mapInArrow(_count_grams(order), "keys binary, gains binary, backs binary, falls binary").collect()
    if not made:
        return ToxicityModel(None, None)
    # The grams of at most per_class documents, sent once for all uses: as plain bytes, which need no code of ours to be read.
    models = docs.sparkSession.sparkContext.broadcast((order, *map(bytes, made.pop())))
    held = sample.where(~F.col("counts")).select("text", "toxic")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = ClassModels.read(*models.value).scorer()
        for b in batches:
            x = evidence(_texts(b.column(0)), scorer)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(FEATURES)), b.column(1)], names=[*(f"x{i}" for i in range(FEATURES)), "toxic"])

    rows = held.mapInArrow(features, ", ".join(f"x{i} double" for i in range(FEATURES)) + ", toxic int").toArrow()
    y = rows["toxic"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return ToxicityModel(None, None)
    return ToxicityModel(models, logistic(np.column_stack([rows[f"x{i}"].to_numpy() for i in range(FEATURES)]), y))


def predict(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs with score and predicted added, in place of columns of these names; a null text counts as empty."""
    state: dict[str, WordScores] = {}
    names = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = (state.get("scorer") or state.setdefault("scorer", ClassModels.read(*model.models.value).scorer())) if model.models else None
        for b in batches:
            score = model.score(_texts(b.column(text)), scorer)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    fields = [*docs.select(*names).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.select(*names).mapInArrow(run, T.StructType(fields))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train: Column | None = None, **limits: int) -> DataFrame:
    """Rows of docs that score below the threshold, unchanged. train: which labelled rows to learn from, all by default."""
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), F.lit(True) if train is None else train, **limits)
    places = {c: f"_{i}" for i, c in enumerate(docs.columns)}  # names that cannot clash
    scored = predict(docs.select(*(F.col(c).alias(p) for c, p in places.items())), model, threshold, places["text"])
    return scored.where("predicted = 0").select(*(F.col(p).alias(c) for c, p in places.items()))


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, threshold: float = 0.7, **limits: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Labels (doc_id, toxic) of rows whose crc32(doc_id) modulo folds is not `fold` train the models. Other columns are
    ignored, whatever their names. Null, empty and blank texts are scored like any other, from no evidence; very long
    texts whole, words of more than WIDTH bytes in parts. Repeated rows are scored each; equal scores need no order; an
    empty table gives an empty one; without labels of both classes every score is 0.
    """
    held = remainder(F.col("doc_id"), folds) == fold
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(slim, labels.select("doc_id", "toxic"), ~held, **limits)
    return predict(slim.select("doc_id", held.alias("held_out"), "text"), model, threshold).drop("text")


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    """op9: toxicity of every document."""
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
