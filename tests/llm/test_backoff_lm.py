import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagloom.llm import backoff_lm as m


def brute(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words, bigrams = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            w = [*m.words_of((t or "").encode()), m.END]
            words.update(w)
            bigrams.update(zip([m.START, *w], w, strict=False))
    total, kinds = sum(words.values()), len(words)
    auto = m.BackoffAutomaton(words, bigrams, total, kinds)
    out = []
    for i, t in rows:
        w = m.words_of((t or "").encode())
        base = sum(math.log10((words[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in (*w, m.END))
        out.append((i, held(i), len(w) + 1, sum(words[x] > 0 for x in (*w, m.END)), total, base, auto.traverse(w)))
    return out, auto, words


def rows():
    r = random.Random(4)
    vocab = ["the", "of", "Über", "X", "über", "cat", "dog", "a", "é"] + [f"w{i}" for i in range(60)]
    out = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 30)))) for i in range(120)]
    return out + [(500, None), (501, ""), (502, " \t "), (503, "the " * 2000), (None, "the cat"), (7, out[7][1]), (504, "never seen words")]


def same(got, want):
    key = lambda r: tuple(str(x) for x in r[:5]) + (round(r[5], 6),)
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_equals_one_automaton(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, block int")
    for block_bytes, shard_bytes, fan in ((4 << 20, 8 << 20, 4096), (300, 500, 4096), (1000, 400, 8), (2500, 700, 3)):
        got = m.score_texts(df, m.remainder(F.col("doc_id"), 5) == 1, block_bytes=block_bytes, shard_bytes=shard_bytes, fan=fan).collect()
        same([tuple(r) for r in got], brute(data)[0])


def test_probabilities_sum_to_one():
    _, auto, words = brute(rows())
    for state in (m.START, b"the", b"cat"):
        mass = sum(10 ** auto.arcs.get((state, w), auto.fail[state] + auto.root[w]) for w in words if words[w])
        assert mass + 10 ** (auto.fail[state] + auto.unknown) == pytest.approx(1)


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in m.score_texts(df, F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].n_known == 0 and got[1].n_tokens == 3 and got[2].n_tokens == 1
    assert m.score_texts(df.limit(0), F.lit(True)).collect() == []


def test_rows_of_questions_are_in_proportion_to_the_text(spark, monkeypatch):
    """At most `fan` rows a block at each level, however much text there is, and one level more for `fan` times the text."""
    r = random.Random(1)
    counted = []
    plain = m.answered

    def counting(questions, *rest):
        counted.append(questions.count())
        return plain(questions, *rest)

    monkeypatch.setattr(m, "answered", counting)
    for n in (100, 400, 1600):
        df = spark.createDataFrame([(i, " ".join(f"w{int(r.paretovariate(0.6))}" for _ in range(60))) for i in range(n)], "doc_id long, text string")
        size = df.agg(F.sum(F.octet_length("text") + 1)).first()[0]
        m.score_texts(df, F.lit(False), block_bytes=3000, shard_bytes=500, fan=8)
        blocks = -(-(size + 1) // 3000)
        assert all(n <= 8 * 8**j * math.ceil(blocks / 8**j) for j, n in enumerate(counted)) and len(counted) == len(m.levels(-(-(size + 1) // 500), 8)) <= math.ceil(math.log(size / 500, 8)) + 1
        counted.clear()


def test_blocks_share_hot_ids(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"word{i % 3} x") for i in range(400)], "doc_id long, text string")
    got = m.score_texts(df, F.lit(False), block_bytes=400, shard_bytes=800)
    assert got.count() == 400 and len({(r.n_tokens, r.train_tokens) for r in got.collect()}) == 1
