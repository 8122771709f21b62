import hashlib
import random
from collections import Counter

import pytest

from tagloom.llm import suffix_dedup as s
from tagloom.llm.deep_shallow import deep_shallow_sort


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in data for p in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def rows(seed):
    r = random.Random(seed)
    text = lambda n, letters="abcdefgh é": "".join(r.choice(letters) for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 150, 400, 1500)]
    out = [text(r.randint(0, 300)) + r.choice(shared) + text(r.randint(0, 300)) + r.choice(shared) for _ in range(60)]
    near = list(text(900))
    for k in range(25):
        copy = near.copy()
        copy[r.randrange(len(copy))] = "#"
        out.append("".join(copy))
    out += ["a" * 100, "a" * 101, "a" * 350, "ab" * 200, "xyz " * 90, None, "", "short", shared[4], shared[4], text(300) * 2]
    return [*enumerate(out), (3, out[3]), (None, out[5]), (0, out[9])]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    data = rows(seed)
    want = brute(data, 100)
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, spans int")
    ways = [(1024, 400_000), (2, 0)] if seed == 1 else [(1024, 0)]  # crowded grams and large tables take other ways
    for most, broadcast_rows in ways:
        got = Counter(tuple(r) for r in s.remove_repeats(df, 100, most, broadcast_rows).drop("kept").collect())
        assert got == want


def test_long_texts_in_parts(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 1000)
    data = rows(3)
    got = Counter(tuple(r) for r in s.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), 100).drop("kept").collect())
    assert got == brute(data, 100)


def test_empty_table(spark):
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_deep_shallow_sort():
    r = random.Random(0)
    for _ in range(200):
        strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 60))]
        order, prefix = deep_shallow_sort(strings, shallow=r.choice([0, 8, 16, 192]))
        assert [strings[i] for i in order] == sorted(strings)
        for a, b, p in zip(order, order[1:], prefix[1:], strict=False):
            x, y = strings[a], strings[b]
            assert x[:p] == y[:p] and (p in (len(x), len(y)) or x[p] != y[p])
