"""Language identification by segmentation-marginalised unigrams.

Each language is a unigram model over the byte pieces of one fixed public vocabulary. A word's probability is the sum
over all of its segmentations into pieces, by the forward algorithm; a text's is the product over its words, each with
a leading space. Piece probabilities are learned by expectation maximisation over the word counts of a sample.

The fit sees a bounded sample: `per_lang` different training documents of each language, whole, those of least hash of
id and text. Languages are fitted apart from one another, each in a task of its own that holds the words of its sample.
The model is one number for each piece and language, so its size is bounded and it travels with the tasks.

Texts are scored whole. Words up to MATRIX bytes go through the forward algorithm many at a time; longer ones, as in
scripts without blanks or in junk, alone, with the last few positions in memory. Only the fit reads words of more than
WIDTH bytes in parts of that length, which its estimates do not mind.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import least_hashes, materialise, remainder, ship
from .wordscores import Lookup, WordScores, chunks, hash_of, mixed, padded, prefix_hashes, substring_hash

ship(__name__)

#: Public vocabulary; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes of a word that the fit reads at once, bytes of a word up to which words are scored as a matrix, and numbers in a matrix.
WIDTH, MATRIX, CELLS = 24, 1024, 1 << 22
#: Bytes of a long word whose pieces are looked up at once.
PART = 1 << 16


def read_pieces(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a vocabulary file of lines "base64 rank", and all single bytes."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted({p for p in pieces if p} | {bytes([b]) for b in range(256)})


def has_letter(text: str) -> bool:
    """Whether a character of the text is of Unicode's category L."""
    return any(map(str.isalpha, text))


class Segmenter:
    """Forward (and backward) sums over the segmentations of many words at once."""

    def __init__(self, hashes: np.ndarray, longest: int) -> None:
        self.lookup, self.longest = Lookup(hashes), longest

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """Lengths, and for each span (start, end): rows that have a piece there, and the pieces."""
        width = max(map(len, words), default=0)
        matrix, lengths = padded(words, max(width, 1))
        prefix, powers = prefix_hashes(matrix)
        out = []
        with np.errstate(over="ignore"):
            for end in range(1, width + 1):
                long_enough = np.flatnonzero(lengths >= end)
                for start in range(max(0, end - self.longest), end):
                    found = self.lookup(substring_hash(prefix[long_enough], powers, start, end))
                    hit = np.flatnonzero(found >= 0)
                    if len(hit):
                        out.append((start, end, long_enough[hit], found[hit]))
        return lengths, out

    def forward(self, lengths: np.ndarray, arcs: list, prob: np.ndarray) -> np.ndarray:
        alpha = np.zeros((len(lengths), (int(lengths.max(initial=0)) + 1), prob.shape[1]))
        alpha[:, 0] = 1
        for start, end, rows, pieces in arcs:
            alpha[rows, end] += alpha[rows, start] * prob[pieces]
        return alpha

    def log_probability(self, words: list[bytes], prob: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, a row for each word; words of any length."""
        out = np.zeros((len(words), prob.shape[1]))
        size = np.fromiter(map(len, words), np.int64, len(words))
        low = -1
        for high in (8, 16, WIDTH, 2 * WIDTH, 128, MATRIX // 4, MATRIX):
            rows = np.flatnonzero((size > low) & (size <= high))
            step = max(1, CELLS // (high * prob.shape[1]))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                out[part] = self._short([words[r] for r in part], prob)
            low = high
        for r in np.flatnonzero(size > MATRIX):
            out[r] = self._long(words[r], prob)
        return out

    def _short(self, words: list[bytes], prob: np.ndarray) -> np.ndarray:
        lengths, arcs = self.arcs(words)
        width = int(lengths.max(initial=0))
        alpha = np.zeros((len(words), width + 1, prob.shape[1]))
        alpha[:, 0] = 1
        shift = np.zeros((len(words), prob.shape[1]))
        out, at = np.zeros_like(shift), 0
        for end in range(width + 1):
            while at < len(arcs) and arcs[at][1] == end:
                start, _, rows, pieces = arcs[at]
                alpha[rows, end] += alpha[rows, start] * prob[pieces]
                at += 1
            done = np.flatnonzero(lengths == end)
            out[done] = np.log(np.maximum(alpha[done, end], 1e-300)) + shift[done]
            if end % 16 == 0 and end:  # numbers stay within range: what lies within reach is scaled
                window = slice(max(0, end - self.longest), end + 1)
                top = np.maximum(alpha[:, window].max(axis=1), 1e-300)
                alpha[:, window] /= top[:, None]
                shift += np.log(top)
        return out

    def _long(self, word: bytes, prob: np.ndarray) -> np.ndarray:
        """The same for one long word, with the sums at the last `longest` positions in memory."""
        reach = self.longest
        ring, shift = np.zeros((reach + 1, prob.shape[1])), np.zeros(prob.shape[1])
        ring[0] = 1
        for first in range(0, len(word), PART):
            back = max(0, first - reach)
            data = np.frombuffer(word[back : first + PART], np.uint8)[None, :]
            prefix, powers = prefix_hashes(data)
            n, ends, sizes, pieces = data.shape[1], [], [], []
            with np.errstate(over="ignore"):
                for size in range(1, min(reach, n) + 1):
                    found = self.lookup(mixed(prefix[0, size:] - prefix[0, :-size] * powers[size], size))
                    hit = np.flatnonzero((found >= 0) & (np.arange(size, n + 1) > first - back))
                    ends.append(hit + size)
                    sizes.append(np.full(len(hit), size))
                    pieces.append(found[hit])
            end, size, piece = np.concatenate(ends), np.concatenate(sizes), np.concatenate(pieces)
            order = np.argsort(end, kind="stable")
            end, size, piece = end[order], size[order], piece[order]
            where = (back + end - size) % (reach + 1)
            cuts = np.searchsorted(end, np.arange(first - back + 1, n + 2)).tolist()
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                at = first + 1 + k
                ring[at % (reach + 1)] = (ring[where[i:j]] * prob[piece[i:j]]).sum(axis=0)
                if at % 16 == 0:
                    top = np.maximum(ring.max(axis=0), 1e-300)
                    ring /= top
                    shift += np.log(top)
        return np.log(np.maximum(ring[len(word) % (reach + 1)], 1e-300)) + shift

    def expected(self, lengths: np.ndarray, arcs: list, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts, words weighted by weight (words x languages)."""
        alpha = self.forward(lengths, arcs, prob)
        beta = np.zeros_like(alpha)
        total = alpha[np.arange(len(lengths)), lengths]
        beta[np.arange(len(lengths)), lengths] = weight / np.maximum(total, 1e-300)
        counts = np.zeros_like(prob)
        for start, end, rows, pieces in reversed(arcs):
            back = prob[pieces] * beta[rows, end]
            np.add.at(counts, pieces, alpha[rows, start] * back)
            beta[rows, start] += back
        return counts


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, each with a leading space."""
    return [b" " + w for w in text.split()]


def word_parts(word: bytes) -> list[bytes]:
    """A word in parts of at most WIDTH bytes, for the fit."""
    return [word[i : i + WIDTH] for i in range(0, len(word), WIDTH)]


class LanguageModel:
    """Languages, their prior and log piece probabilities; scores batches of texts."""

    def __init__(self, langs: list[str], pieces: list[bytes], prob: np.ndarray) -> None:
        self.langs, self.prob, self.longest = langs, prob, max(map(len, pieces))
        self.hashes = np.array([hash_of(p) for p in pieces], dtype=np.uint64)

    def scorer(self) -> WordScores:
        seg = Segmenter(self.hashes, self.longest)
        return WordScores(lambda words: seg.log_probability(words, self.prob), len(self.langs))

    def totals(self, texts: list[bytes], scorer: WordScores) -> np.ndarray:
        """log P(text | language), a row for each text. Long words are not kept in the scorer."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in chunks(texts):
            parts = [words_of(t) for t in texts[a:b]]
            flat = [w for p in parts for w in p]
            if flat:
                long = np.flatnonzero(np.fromiter(map(len, flat), np.int64, len(flat)) > MATRIX).tolist()
                kept = {i: flat[i] for i in long}
                for i in long:
                    flat[i] = b""
                at = scorer(flat)  # before rows are read: it may make more
                each = scorer.rows[at].astype(np.float64)
                for i, w in kept.items():
                    each[i] = scorer.score([w])
                sums = np.vstack([np.zeros((1, out.shape[1])), np.cumsum(each, axis=0)])
                ends = np.cumsum([len(p) for p in parts])
                out[a:b] = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
        return out


def fit(words: list[bytes], counts: np.ndarray, pieces: list[bytes], rounds: int = 4, block: int = 8192) -> np.ndarray:
    """Piece probabilities (pieces x languages) by EM over word counts (words x languages), from a start in which a piece weighs what its occurrences in words do."""
    hashes = np.array([hash_of(p) for p in pieces], dtype=np.uint64)
    seg = Segmenter(hashes, max(map(len, pieces)))
    single = np.array([len(p) == 1 for p in pieces])
    blocks = [(counts[i : i + block], *seg.arcs(words[i : i + block])) for i in range(0, len(words), block)]
    prob = np.zeros((len(pieces), counts.shape[1]))
    for weight, _, arcs in blocks:
        for _, _, rows, found in arcs:
            np.add.at(prob, found, weight[rows])
    for turn in range(rounds + 1):
        if turn:
            now = np.zeros_like(prob)
            for weight, lengths, arcs in blocks:
                now += seg.expected(lengths, arcs, prob, weight)
            prob = now
        prob += 0.01 + single[:, None] * 0.5  # every byte keeps some mass in every language
        prob /= prob.sum(0)
    return prob


def fit_on_sample(docs: DataFrame, train: Column, vocabulary: str = VOCABULARY, per_lang: int = 400) -> LanguageModel | None:
    """Model from documents (doc_id, text, lang) for which train holds; None if none has a language and a word.

    Documents are told apart by id and text: rows that repeat are one, and rows with a null id stay different documents.
    """
    pieces = read_pieces(vocabulary)
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.xxhash64("doc_id", "text"))
    chosen = least_hashes(usable, "lang", "key", per_lang).select(F.col("lang").alias("_lang"), F.col("key").alias("_key"))
    chosen = F.broadcast(materialise(chosen, "sample"))  # per_lang rows of a number for each language
    sample = usable.join(chosen, (F.col("lang") == F.col("_lang")) & (F.col("key") == F.col("_key")), "left_semi")
    # Distinct words of a document count once, so that one long or repetitive text does not set the model; of repeated rows too.
    found = sample.select("lang", "key", F.explode(F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+"))).alias("w")).where("w <> ''").distinct()
    counted = found.groupBy("lang", "w").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def one(key: tuple, words: pa.Table) -> pa.Table:
        parts: dict[bytes, float] = {}
        for w, n in zip(words["w"].to_pylist(), words["n"].to_pylist(), strict=True):
            for p in word_parts(b" " + w.encode()):
                parts[p] = parts.get(p, 0.0) + n
        prob = fit(list(parts), np.array(list(parts.values()))[:, None], pieces)
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "prob": pa.array([prob[:, 0].tobytes()], pa.binary())})

    # A task holds the words of per_lang documents; the driver gets one number a piece and language.
    rows = counted.groupBy("lang").applyInArrow(one, "lang string, prob binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.lang)
    return LanguageModel([r.lang for r in rows], pieces, np.column_stack([np.frombuffer(bytes(r.prob)) for r in rows]))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for docs (doc_id, text, held_out).

    score is the posterior of the named language under equal priors. A null text, or one without a letter of Unicode's
    category L (empty and blank ones too), is `und` with score 0; so is every text if there is no model.
    """
    state: dict[str, WordScores] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = state.setdefault("scorer", model.scorer()) if model else None
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            named, score = ["und"] * len(texts), np.zeros(len(texts))
            live = [i for i, t in enumerate(texts) if scorer and t and has_letter(t)]
            if live:
                total = model.totals([texts[i].encode() for i in live], scorer)
                total -= total.max(axis=1, keepdims=True)
                share = np.exp(total) / np.exp(total).sum(axis=1, keepdims=True)
                for i, row in zip(live, share, strict=True):
                    best = int(row.argmax())
                    named[i], score[i] = model.langs[best], float(row[best])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(named, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, vocabulary: str = VOCABULARY, per_lang: int = 400, folds: int = 4, fold: int = 2) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) modulo folds is not `fold`, then predict every row of docs.

    Columns used: doc_id, text, lang; others are ignored, whatever their names. Repeated rows are predicted each; ties go
    to the language that sorts first; a null id counts as the empty text in the folds and keeps its row; null, empty and
    letterless texts are `und`; very long texts and words are scored whole; an empty table gives an empty one.
    """
    held = remainder(F.col("doc_id"), folds) == fold
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit_on_sample(slim, ~held, vocabulary, per_lang)
    return predict(slim.select("doc_id", "text", held.alias("held_out")), model)


def language_query(spark, sf_dir: str) -> DataFrame:
    """op10: the language of every document."""
    return identify_languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
