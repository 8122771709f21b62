import random

from tagloom.llm import shingle_sets, simhash_golay
from tagloom.llm.shingle_sets import similar_groups
from tagloom.llm.simhash_golay import fingerprint, keep_one


def sets(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts):
    found = [sets(t) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(found):
            for j, b in enumerate(found):
                if label[j] < label[i] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                    label[i], changed = label[j], True
    return label


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def test_components_equal_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    line = " ".join(r.choices(vocab, k=12))
    texts = []
    for _ in range(30):
        base = r.choices(vocab, k=r.randint(20, 200))
        texts += [" ".join(base), *(edited(r, base, k) for k in (1, 2, 3, 5)), " ".join(base[: len(base) * 9 // 10])]
    crowd = r.choices(vocab, k=150)
    texts += [edited(r, crowd, r.randint(1, 5)) for _ in range(60)]
    texts += [f"{line} {r.choice(vocab)} {r.choice(vocab)}" for _ in range(40)] + [None, "", " \t", "One two", "one  TWO", "a b c d e", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts)
    for most in (32, 3, 1000):
        got = {x.doc_id: x.component_id for x in similar_groups(df, most=most).collect()}
        assert got == dict(enumerate(want)), most
    assert similar_groups(df.limit(0)).collect() == []


def test_keep_one_drops_edited_copies(spark):
    r = random.Random(9)
    base = [f"w{r.randrange(500)}" for _ in range(300)]
    near, far = edited(r, base, 6), edited(r, base, 60)
    prints = [fingerprint(t.encode()) for t in (" ".join(base), near)]
    assert (prints[0] ^ prints[1]).bit_count() > 2
    df = spark.createDataFrame([(1, " ".join(base)), (2, near), (3, far)], "doc_id long, text string")
    assert sorted(x.doc_id for x in keep_one(df).collect()) == [1, 3]


def test_links_go_through_fingerprints_and_whole_sets_are_not_written(spark, monkeypatch):
    r = random.Random(5)
    bases = [[f"w{r.randrange(5000)}" for _ in range(200)] for _ in range(80)]
    texts = [" ".join(b) for b in bases] + [edited(r, b, 2) for b in bases[:40]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole, tried, real = [], [], (shingle_sets.materialise, simhash_golay.near_pairs)

    def written(table, name):
        out = real[0](table, name)
        whole.extend(x for column, kind in out.dtypes if kind == "array<bigint>" for x in out.selectExpr(f"size({column}) AS n").collect() if x.n > 100)
        return out

    def meetings(sets):
        for most in (256, 1):  # 1: crowded groups
            pairs = {(x.u, x.v) for x in real[1](sets, most=most).collect()}
            tried.append(len(pairs))
        return real[1](sets)

    monkeypatch.setattr(shingle_sets, "materialise", written)
    monkeypatch.setattr(simhash_golay, "near_pairs", meetings)
    assert sorted(x.doc_id for x in keep_one(df).collect()) == list(range(80))
    # Of 40 similar pairs fingerprints find most, and nothing else; only sets that are compared are written whole.
    assert len(tried) == 2 and all(30 <= n <= 40 for n in tried) and len(whole) <= 80


def test_a_family_of_unlike_texts_meets_rarely(spark, monkeypatch):
    # Each shares about two thirds with any other, so all have common shingles in their prefixes, but few are near-duplicates.
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    texts = [edited(r, base, 3) for _ in range(60)]
    rows, real = [], shingle_sets._meeting
    monkeypatch.setattr(shingle_sets, "_meeting", lambda left: rows.append(real(left).count()) or real(left))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in similar_groups(df).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert sum(rows) < 60 * 59 / 2, rows
