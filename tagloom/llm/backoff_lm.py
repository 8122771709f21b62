"""Language-model scoring with a weighted backoff automaton.

The model is a word bigram with Dirichlet smoothing, p(w | u) = (c(uw) + mu p(w)) / (c(u) + mu), over an add-half
unigram p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). As an automaton it has a root, a state for each history (the start of
a text, and every word seen in training), an arc for each bigram seen, and from each state a failure arc to the root
with weight mu / (c(u) + mu). A text is read once from left to right: in state u, word w takes the arc if there is one,
else the failure arc and then the root's arc; the next state is w's, or the root if w is unknown.

The counts are those of the whole corpus and live on no single machine. Documents are dealt to blocks by a hash of
their id and place. A block asks for the totals of its own different words and bigrams; the questions are dealt to
ranges of a 64-bit hash, summed there, and the answers go back, as bare arrays in the order of the question. A block
then builds the part of the automaton that its texts can reach and reads them with it. Blocks and ranges grow in number
with the corpus, not in size: a block is about `block_bytes` of text, a range gets the questions of about `shard_bytes`.

A block asks at most `fan` ranges. Where the corpus has more of them, `fan` blocks at a time are merged within each range,
their questions summed and dealt to `fan` finer ranges, and so on; so a block has at most `fan` rows a level, the levels
grow like a logarithm, and the rows in proportion to the text. No task holds more than about a block's questions at once.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, ship

ship(__name__)

MU = 30.0
#: The start of a text and its end, which no word can equal: words hold no blanks.
START, END = b" <", b" >"


class BackoffAutomaton:
    """States, arcs and failure arcs, from counts of words (END among them) and of bigrams (START may come first).

    kinds and total are the corpus's V and N; they differ from the counts given if these are only a part of it. Inside,
    words and states are numbers, and the root is the state after the last word's.
    """

    def __init__(self, words: dict[bytes, int], bigrams: dict[tuple[bytes, bytes], int], total: int, kinds: int, mu: float = MU) -> None:
        self.number = {w: i for i, w in enumerate(dict.fromkeys([START, END, None, *words]))}  # None: any unknown word
        counts = np.array([words.get(w, 0) for w in self.number], float)
        pairs = np.array([(self.number[u], self.number[w]) for u, w in bigrams], np.int64).reshape(-1, 2)
        self._weigh(counts, pairs[:, 0], pairs[:, 1], np.array(list(bigrams.values()), float), total, kinds, mu, 0, 1)
        # The same by name.
        self.root = {w: self._root[i] for w, i in self.number.items() if counts[i]}
        self.fail = {w: self._fail[i] for w, i in self.number.items() if self._to[i] == i or (w == START and counts[1])}
        self.arcs = {(u, w): self._arcs[self.number[u] * self.width + self.number[w]] for (u, w), c in bigrams.items() if c}

    @classmethod
    def of_arrays(cls, counts: np.ndarray, states: np.ndarray, nexts: np.ndarray, seen: np.ndarray, total: int, kinds: int, mu: float, start: int, end: int) -> BackoffAutomaton:
        """The same from the counts of numbered words, and bigrams (states, nexts) with theirs."""
        out = cls.__new__(cls)
        out._weigh(counts, states, nexts, seen, total, kinds, mu, start, end)
        return out

    def _weigh(self, counts: np.ndarray, states: np.ndarray, nexts: np.ndarray, seen: np.ndarray, total: int, kinds: int, mu: float, start: int, end: int) -> None:
        unit, n = total + 0.5 * (kinds + 1), len(counts)
        self.start, self.end, self.width, self.unknown = start, end, n, float(np.log10(0.5 / unit))
        share = (counts + 0.5) / unit
        history = counts.astype(float)
        history[start], history[end] = counts[end], 0  # a text's start is as frequent as its end, which is no history itself
        some = seen > 0
        u, w = states[some], nexts[some]
        weight = np.log10((seen[some] + mu * share[w]) / (history[u] + mu))
        self._arcs = dict(zip((u * n + w).tolist(), weight.tolist(), strict=True))
        self._root = np.log10(share).tolist()
        self._fail = [*np.where(history > 0, np.log10(mu / (history + mu)), 0.0).tolist(), 0.0]
        self._to = np.where((history > 0) & (np.arange(n) != start), np.arange(n), n).tolist()

    def follow(self, words: list[int]) -> float:
        """log10 probability of numbered words, the end among them: one pass from left to right that carries the state."""
        arcs, fail, root, to, width = self._arcs.get, self._fail, self._root, self._to, self.width
        state, score = self.start, 0.0
        for w in words:
            arc = arcs(state * width + w)
            score += fail[state] + root[w] if arc is None else arc
            state = to[w]
        return score

    def traverse(self, words: Iterable[bytes]) -> float:
        """log10 probability of a text's words and its end."""
        return self.follow([self.number.get(w, self.number[None]) for w in (*words, END)])


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def _mix(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = u * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(31)))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Block:
    """Different words and bigrams of a block of texts, by hash, with their counts in training texts and their places."""

    def __init__(self, table: pa.Table) -> None:
        texts = [words_of(t.as_py() or b"") for t in table["text"].combine_chunks().cast(pa.large_binary())] if table.num_rows else []
        train = ~np.asarray(table["held_out"].combine_chunks().fill_null(True).to_numpy(zero_copy_only=False)).astype(bool) if table.num_rows else np.empty(0, bool)
        self.lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        flat = [w for t in texts for w in (*t, END)]
        index: dict[bytes, int] = {START: 0}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in flat), np.int64, len(flat))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, index), np.uint64, len(index))
        first = np.zeros(len(flat), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        before = np.concatenate([[0], ids[:-1]]) if len(ids) else ids
        before[first] = 0
        trained = np.repeat(train, self.lengths)
        self.order = np.argsort(hashes)
        self.words = hashes[self.order]
        self.place = np.empty(len(index), np.int64)
        self.place[self.order] = np.arange(len(index))
        self.ids, self.before, self.end = self.place[ids], self.place[before], self.place[index.get(END, 0)]
        self.start = int(self.place[0])
        self.word_counts = np.bincount(self.ids[trained], minlength=len(index))
        self.bigrams, at, arcs = np.unique(_mix(hashes[before], hashes[ids]), return_index=True, return_inverse=True)
        self.states, self.nexts = self.before[at], self.ids[at]
        self.bigram_counts = np.bincount(arcs[trained], minlength=len(self.bigrams))

def _pack(numbers: np.ndarray) -> bytes:
    """Numbers with all first bytes together, then all second bytes and so on: the shuffle's compression finds the zeros."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes, as differences."""
    return _pack(np.diff(h, prepend=np.uint64(0)))


def _hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _cuts(words: np.ndarray, bigrams: np.ndarray, ranges: int, first: int, n: int) -> list[tuple[int, int, int, int, int]]:
    """(range, first and last of its words, of its bigrams) for those of the n ranges from `first` on, out of `ranges`, that get any of the sorted hashes."""
    edge = np.arange(first, first + n + 1, dtype=np.uint64)
    a, b = (np.searchsorted(((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32), edge).tolist() for h in (words, bigrams))
    return [(first + s, a[s], a[s + 1], b[s], b[s + 1]) for s in range(n) if a[s] < a[s + 1] or b[s] < b[s + 1]]


QUESTION = "part long, owner long, words binary, word_counts binary, bigrams binary, bigram_counts binary"
ANSWER = "part long, owner long, words binary, bigrams binary, total long, kinds long"
KIND = {"long": pa.int64(), "binary": pa.binary()}


def _rows(shape: str, rows: list[tuple]) -> pa.Table:
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], KIND[c.split()[1]]) for i, c in enumerate(shape.split(", "))})


def _questions(owner: int, words: np.ndarray, word_counts: np.ndarray, bigrams: np.ndarray, bigram_counts: np.ndarray, ranges: int, first: int, n: int) -> pa.Table:
    cuts = _cuts(words, bigrams, ranges, first, n)
    return _rows(QUESTION, [(s, owner, _planes(words[i:j]), _pack(word_counts[i:j]), _planes(bigrams[k:m]), _pack(bigram_counts[k:m])) for s, i, j, k, m in cuts])


def _ask(ranges: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        b = _Block(table)
        return _questions(key[0].as_py(), b.words, b.word_counts, b.bigrams, b.bigram_counts, ranges, 0, ranges)

    return run


class _Sums:
    """Different entries of several questions, their totals, and the place of each entry of each question."""

    def __init__(self, hashes: list[bytes], counts: list[bytes]) -> None:
        each = [_hashes(h) for h in hashes]
        self.different, self.where = np.unique(np.concatenate(each), return_inverse=True)
        self.totals = np.bincount(self.where, weights=np.concatenate([_unpack(c) for c in counts]), minlength=len(self.different)).astype(np.int64)
        self.ends = np.cumsum([len(h) for h in each])

    def dealt(self, totals: np.ndarray) -> list[bytes]:
        """totals for each question in its order."""
        return [_pack(totals[w]) for w in np.split(self.where, self.ends[:-1])]


def _both(table: pa.Table) -> tuple[_Sums, _Sums]:
    return tuple(_Sums(table[c].to_pylist(), table[n].to_pylist()) for c, n in (("words", "word_counts"), ("bigrams", "bigram_counts")))


def _answer(key: tuple, table: pa.Table) -> pa.Table:
    """One row for each question of a range; the first also has the range's share of N and V."""
    words, bigrams = _both(table)
    n = table.num_rows
    share = [(int(words.totals.sum()), int((words.totals > 0).sum())), *[(0, 0)] * (n - 1)]
    dealt = zip(table["part"].to_pylist(), table["owner"].to_pylist(), words.dealt(words.totals), bigrams.dealt(bigrams.totals), share, strict=True)
    return _rows(ANSWER, [(p, o, w, b, *s) for p, o, w, b, s in dealt])


def _merge(ranges: int, n: int):
    """The questions of some owners in one range as those of one owner in n finer ranges, `ranges` in all."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        words, bigrams = _both(table)
        return _questions(key[1].as_py(), words.different, words.totals, bigrams.different, bigrams.totals, ranges, key[0].as_py() * n, n)

    return run


def _spread(ranges: int, n: int):
    """Answers to merged questions as answers to the owners' own."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        words, bigrams = _both(table)
        one, two = np.zeros(len(words.different), np.int64), np.zeros(len(bigrams.different), np.int64)
        slices = {s: c for s, *c in _cuts(words.different, bigrams.different, ranges, key[0].as_py() * n, n)}
        for s, w, b in zip(*(answers[c].to_pylist() for c in ("part", "words", "bigrams")), strict=True):
            i, j, k, m = slices[s]
            one[i:j], two[k:m] = _unpack(w), _unpack(b)
        share = [(sum(answers["total"].to_pylist()), sum(answers["kinds"].to_pylist())), *[(0, 0)] * (table.num_rows - 1)]
        dealt = zip(table["part"].to_pylist(), table["owner"].to_pylist(), words.dealt(one), bigrams.dealt(two), share, strict=True)
        return _rows(ANSWER, [(p, o, w, b, *s) for p, o, w, b, s in dealt])

    return run


def answered(questions: DataFrame, ranges: int, finer: list[int], fan: int) -> DataFrame:
    """ANSWER rows for QUESTION rows in `ranges` ranges, which are cut into finer[0] ranges each, and so on."""
    if not finer:
        return questions.groupBy("part").applyInArrow(_answer, ANSWER)
    grouped = questions.withColumn("team", F.floor(F.col("owner") / fan))
    n, below = finer[0], ranges * finer[0]
    merged = grouped.groupBy("part", "team").applyInArrow(_merge(below, n), QUESTION)
    up = answered(merged, below, finer[1:], fan).withColumns({"over": F.floor(F.col("part") / n), "team": F.col("owner")})
    return grouped.groupBy("part", "team").cogroup(up.groupBy("over", "team")).applyInArrow(_spread(below, n), ANSWER)


def levels(ranges: int, fan: int) -> list[int]:
    """Numbers of ranges, level by level, `fan` at most, with a product of at least `ranges`."""
    out = []
    while ranges > fan:
        out.append(fan)
        ranges = -(-ranges // fan)
    return [*out, ranges]


def _read(ranges: int, mu: float):
    """Scores of a block's texts: the automaton of what they can reach, and a traversal of each."""

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        b = _Block(docs)
        c1, c2 = np.zeros(len(b.words)), np.zeros(len(b.bigrams))
        slices = {s: c for s, *c in _cuts(b.words, b.bigrams, ranges, 0, ranges)}
        for s, words, bigrams in zip(*(answers[n].to_pylist() for n in ("part", "words", "bigrams")), strict=True):
            i, j, k, m = slices[s]
            c1[i:j], c2[k:m] = _unpack(words), _unpack(bigrams)
        total, kinds = (answers[n][0].as_py() if answers.num_rows else 0 for n in ("n_all", "v_all"))
        auto = BackoffAutomaton.of_arrays(c1, b.states, b.nexts, c2, total, kinds, mu, b.start, int(b.end))
        base = np.log10((c1 + 0.5) / (total + 0.5 * (kinds + 1)))
        ends = np.cumsum(b.lengths)
        first, n = ends - b.lengths, len(b.lengths)
        gather = lambda x: np.add.reduceat(x, first) if n else np.empty(0)
        read = (auto.follow(b.ids[i:j].tolist()) for i, j in zip(first.tolist(), ends.tolist(), strict=True))
        return pa.table({
            "doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": pa.array(b.lengths, pa.int64()),
            "n_known": pa.array(gather((c1[b.ids] > 0).astype(np.int64)).astype(np.int64)), "train_tokens": pa.array(np.full(n, total, np.int64)),
            "base_score": pa.array(gather(base[b.ids]).astype(float)), "score": pa.array(np.fromiter(read, float, n)),
        })

    return run


def score_texts(docs: DataFrame, held_out: Column, mu: float = MU, block_bytes: int = 4 << 20, shard_bytes: int = 8 << 20, fan: int = 4096) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Rows for which held_out is not true train the model. Texts are lower-cased (A-Z) and cut at ASCII blanks; each ends
    with an end token; a null text is empty, and an empty one has just its end; a text of any length is read whole, in
    one block. Rows repeat as they are, and count as often; null and repeated ids are spread over the blocks like others;
    without training rows all counts are 0; other columns are ignored; an empty table gives an empty one. docs should
    give its rows in the same order each time it is read, as files do.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = slim.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    blocks = -(-(size + 1) // block_bytes)
    first, *finer = levels(-(-(size + 1) // shard_bytes), fan)
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("long"))
    # One plan: the texts are shuffled once, as both uses of a block read the same exchange.
    asked = dealt.groupBy("block").applyInArrow(_ask(first), QUESTION)
    answers = answered(asked, first, finer, fan)
    every = answers.agg(F.sum("total").alias("n_all"), F.sum("kinds").alias("v_all"))
    answers = answers.select("part", F.col("owner").alias("block"), "words", "bigrams").join(F.broadcast(every))
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_read(first, mu), shape)


def lm_query(spark, sf_dir: str) -> DataFrame:
    """op6: scores of all documents by the model of those whose crc32(doc_id) modulo 5 is not 1."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), remainder(F.col("doc_id"), 5) == 1)
