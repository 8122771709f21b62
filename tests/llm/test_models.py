"""Toxicity and language identification, on held-out rows and odd ones."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tagloom.llm import language_id as lang
from tagloom.llm import toxicity as tox
from tagloom.llm.common import least_hashes
from tagloom.llm.wordscores import Lookup, WordScores, hash_of, padded, prefix_hashes, substring_hash

ODD = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "12 34 !!"), (9005, "x" * 100_000), (None, "no id"), (9002, ""), (9006, "日本 語")]


def test_hashes_and_lookups_agree():
    words = [b"", b"a", b"abc", b"aXbc"]
    m, lengths = padded(words, 4)
    prefix, powers = prefix_hashes(m)
    assert list(lengths) == [0, 1, 3, 4]
    with np.errstate(over="ignore"):
        assert int(substring_hash(prefix, powers, 1, 3)[2]) == hash_of(b"bc") and int(substring_hash(prefix, powers, 2, 4)[3]) == hash_of(b"bc")
    hashes = np.array([hash_of(str(i).encode()) for i in range(1000)], dtype=np.uint64)
    find = Lookup(hashes)
    assert (find(hashes[::-1].copy()) == np.arange(999, -1, -1)).all() and (find(np.array([hash_of(b"none")], dtype=np.uint64)) == -1).all()
    scores = WordScores(lambda ws: np.array([[len(w)] for w in ws]), 1, most=3)
    for batch in ([b"a", b"bb", b"a"], [b"ccc", b"dddd"], [b"a", b"eeeee"]):
        assert list(scores.rows[scores(batch), 0]) == [len(w) for w in batch]


def brute_forward(word, pieces, prob):
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        total[end] = sum(total[start] * prob.get(word[start:end], 0) for start in range(end))
    return total[-1]


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba"]
    prob = np.array([[0.3, 0.1], [0.2, 0.3], [0.2, 0.2], [0.2, 0.1], [0.1, 0.3]])
    seg = lang.Segmenter(np.array([hash_of(p) for p in pieces], dtype=np.uint64), 3)
    words = [b"aba", b"b", b"abab", b"c"]
    got = np.exp(seg.log_probability(words, prob))
    for i, w in enumerate(words):
        for k in (0, 1):
            assert got[i, k] == pytest.approx(brute_forward(w, pieces, dict(zip(pieces, prob[:, k], strict=True))))
    lengths, arcs = seg.arcs(words[:3])
    counts = seg.expected(lengths, arcs, prob, np.ones((3, 2)))
    size = np.array([len(p) for p in pieces])[:, None]
    assert (counts * size).sum(0) == pytest.approx([8, 8])  # every byte is in one piece of each segmentation


def test_words_of_any_length_are_summed_whole():
    pieces = [bytes([c]) for c in b"abc"] + [b"ab", b"bca", b"cab" * 9]
    prob = np.array([[0.3, 0.1], [0.2, 0.3], [0.1, 0.2], [0.2, 0.1], [0.1, 0.2], [0.1, 0.1]])
    seg = lang.Segmenter(np.array([hash_of(p) for p in pieces], dtype=np.uint64), 27)
    words = [b"abcab" * n for n in (1, 4, 6, 20, 50, 190)]
    got = seg.log_probability(words, prob)
    for i, w in enumerate(words):
        for k in (0, 1):
            total = [Fraction(1)]
            known = {p: Fraction(float(x)) for p, x in zip(pieces, prob[:, k], strict=True)}
            for end in range(1, len(w) + 1):
                total.append(sum((total[s] * known[w[s:end]] for s in range(max(0, end - 27), end) if w[s:end] in known), Fraction(0)))
            want = math.log(total[-1].numerator) - math.log(total[-1].denominator)
            assert got[i, k] == pytest.approx(want, rel=1e-9)
        assert seg._long(w, prob) == pytest.approx(got[i], rel=1e-9)
    some, lang.PART = lang.PART, 64
    try:
        assert seg._long(words[-1], prob) == pytest.approx(got[-1], rel=1e-9)
    finally:
        lang.PART = some


def test_many_different_words():
    pieces = [bytes([c]) for c in range(256)]
    model = lang.LanguageModel(["a", "b"], pieces, np.full((256, 2), 1 / 256))
    texts = [" ".join(f"w{i}x{j}" for i in range(900)).encode() for j in range(4)] + [b"y" * 3000 + b" z"]
    got = model.totals(texts, model.scorer())
    assert got[:, 0] == pytest.approx([-math.log(256) * (len(t) + 1) for t in texts], rel=1e-5)


def test_letters_are_category_l():
    assert lang.has_letter("½a") and lang.has_letter("日") and not any(map(lang.has_letter, ("½²①", "12 _-", "", "Ⅷ")))


def test_null_and_repeated_ids_keep_their_languages(spark):
    r = random.Random(4)
    text = lambda words: " ".join(r.choices(words, k=12))
    de, en, it = "der haus und groß jahr".split(), "the house and great year".split(), "casa grande anno della".split()
    rows = [(i, text(en), "en") for i in range(50)] + [(100 + i, text(de), "de") for i in range(40)] + [(None, text(de), "de") for _ in range(60)]
    rows += [(500, "casa grande", "it")] * 300 + [(501, text(it), "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang.fit_on_sample(df, lang.F.lit(True), per_lang=30)
    assert model.langs == ["de", "en", "it"]
    clash = df.withColumns({"key": lang.F.lit(1), "_lang": lang.F.lit("x"), "held_out": lang.F.lit(5), "score": lang.F.lit(2)})
    got = lang.identify_languages(clash, per_lang=30)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == len(rows) and got.where("doc_id = 501").first().lang_pred == "it"


def test_predictions_equal_brute_force(spark, spoken):
    """The query's posterior against sums over all segmentations, word by word."""
    df = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    held = lang.remainder(lang.F.col("doc_id"), 4) == 2
    model = lang.fit_on_sample(df, ~held, per_lang=40)
    known = [dict(zip(lang.read_pieces(), column, strict=True)) for column in model.prob.T]
    got = {r.doc_id: r for r in lang.identify_languages(df, per_lang=40).collect()}
    for i, t, _ in spoken[:25]:
        total = [sum(math.log(brute_forward(b" " + w, None, prob)) for w in t.encode().split()) for prob in known]
        top = max(total)
        assert got[i].lang_pred == model.langs[total.index(top)] and got[i].score == pytest.approx(1 / sum(math.exp(x - top) for x in total), rel=1e-3)


@pytest.fixture(scope="module")
def spoken():
    r = random.Random(0)
    vocab = {"en": "the of and with house water think great year".split(), "de": "der die und mit haus wasser denken groß jahr".split(), "fr": "le la et avec maison eau penser grande année".split()}
    return [(i, " ".join(r.choices(vocab[k], k=r.randint(3, 30))), k) for i in range(300) for k in [r.choice(list(vocab))]]


def test_languages_of_held_out_rows(spark, spoken):
    df = spark.createDataFrame([*spoken, *((i, t, None) for i, t in ODD)], "doc_id long, text string, lang string")
    rows = lang.identify_languages(df, per_lang=40).collect()
    truth = {i: k for i, _, k in spoken}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == len(spoken) + len(ODD) and len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) >= 0.9
    odd = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id > 9000}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (9001, 9002, 9003, 9004)) and odd[9006].lang_pred in ("en", "de", "fr")
    assert all(0 <= r.score <= 1 for r in rows)


def test_without_languages(spark):
    none = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in lang.identify_languages(none).collect()] == ["und"] and lang.identify_languages(none.limit(0)).collect() == []


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(1)
    plain = [f"{a}{b}" for a in "ba de ki lo mu sa te vi".split() for b in "ran sel tor min dak lup".split()]
    rude = ["idiot", "scumbag", "moron", "trashy", "loser"]
    docs, labels = [], []
    for i in range(600):
        toxic = r.random() < 0.3
        words = r.choices(plain, k=r.randint(5, 60))
        for w in r.sample(rude, r.randint(1, 3)) if toxic else []:
            words.insert(r.randrange(len(words)), w)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_rows(spark, labelled):
    docs, labels = labelled
    df = spark.createDataFrame([*((i, t, 0.5) for i, t in docs), *((i, t, 0.1) for i, t in ODD)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (5, None), (None, 1), (77777, 1)], "doc_id long, toxic int")
    rows = tox.score_toxicity(df, lab).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == len(docs) + len(ODD) and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    odd = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id > 9000}
    assert all(odd[i].predicted == 0 for i in (9001, 9002, 9003))
    kept = tox.reject_toxic(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in tox.score_toxicity(df, lab, folds=10**6, fold=-1).collect() if not r.predicted}


def test_class_models_are_distributions():
    words = [b"^abc$", b"^abd$", b"^bca$", b"^ca$"]
    counts = np.array([[5, 1], [2, 0], [0, 3], [1, 1]], dtype=float)
    score = tox.ClassModels(words, counts, order=4).scorer()
    rows = score.rows[score([b"^bca$", b"^abd$", b"^zz$"])]
    assert rows[0, 0] > 0 > rows[1, 0] and abs(rows[2, 0]) < abs(rows[0, 0])


class KneserNey:
    """One class of interpolated Kneser-Ney models in plain Python; orders up to shared + 1 count both classes."""

    def __init__(self, words, counts, c, order, shared):
        grams = {}
        for n in range(1, order + 1):
            seen = {}
            for w, k in zip(words, counts, strict=True):
                for end in range(max(n, 2), len(w) + 1):
                    g = w[end - n : end]
                    seen[g] = seen.get(g, 0) + np.array(k)
            if n > 3:
                seen = {g: k for g, k in seen.items() if k.sum() >= 2}
            if not seen:
                break
            grams[n] = seen
        self.prob, self.back = {}, {}
        for n, seen in grams.items():
            held = {g: k.astype(float) for g, k in seen.items()}
            if n + 1 in grams:
                for g in held:
                    if not g.startswith(b"^"):
                        held[g] = sum(((k > 0).astype(float) for longer, k in grams[n + 1].items() if longer[1:] == g), np.zeros(2))
            count = {g: k.sum() if n <= shared + 1 else k[c] for g, k in held.items()}
            for context in {g[:-1] for g in count}:
                own = {g: k for g, k in count.items() if g[:-1] == context}
                total = sum(own.values())
                self.back[context] = sum(min(k, 0.75) for k in own.values()) / total if total else 1.0
                for g, k in own.items():
                    below = self.prob[g[1:]] if n > 1 else 1 / 256
                    self.prob[g] = (max(k - 0.75, 0) / total if total else 0) + self.back[context] * below
        self.order = order

    def next(self, context, byte):
        context = context[max(0, len(context) - self.order + 1) :]
        weight = 1.0
        while True:
            if context + byte in self.prob:
                return weight * self.prob[context + byte]
            weight *= self.back.get(context, 1.0)
            if not context:
                return weight / 256
            context = context[1:]


@pytest.mark.parametrize("order,shared", [(2, 0), (4, 2), (6, 1)])
def test_class_models_equal_brute_force(order, shared):
    r = random.Random(order)
    words = sorted({b"^" + bytes(r.choices(b"abcd", k=r.randint(1, 7))) + b"$" for _ in range(60)})
    counts = [(r.randint(0, 4), r.randint(0, 3)) for _ in words]
    plain = [KneserNey(words, counts, c, order, shared) for c in (0, 1)]
    for m in plain:
        for context in (b"^", b"^a", b"ab", b"abcd", b"zz"):
            assert sum(m.next(context, bytes([b])) for b in range(256)) == pytest.approx(1)
    score = tox.ClassModels(words, np.array(counts, dtype=float), order=order, shared=shared).scorer()
    asked = [*words[:20], b"^dcba$", b"^zebra$", b"^a"]
    got = score.rows[score(asked)]
    for w, (total, mean) in zip(asked, got, strict=True):
        want = sum(math.log(plain[1].next(w[:i], w[i : i + 1]) / plain[0].next(w[:i], w[i : i + 1])) for i in range(1, len(w)))
        assert total == pytest.approx(want, abs=1e-4) and mean == pytest.approx(want / (len(w) - 1), abs=1e-4)


def test_scores_equal_brute_force(spark, labelled):
    """The query's scores against features and curve in plain Python, from the models that the fit made."""
    docs, labels = labelled
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tox.fit(df, lab, tox.remainder(tox.F.col("doc_id"), 3) != 1)
    ratios = tox.ClassModels.read(*model.models.value).scorer()
    mean, scale, w = model.curve
    got = {r.doc_id: r.score for r in tox.score_toxicity(df, lab).collect()}
    for i, t in docs[:60]:
        words = [b"^" + x + b"$" for x in t.encode().split()]
        each = {x: ratios.rows[ratios([x])[0]] for x in words}
        x = [sum(each[v][0] for v in words) / sum(len(v) - 1 for v in words), *sorted((e[1] for e in each.values()), reverse=True)[:3], *sorted((e[0] for e in each.values()), reverse=True)[:3]]
        z = sum((a - m) / s * k for a, m, s, k in zip(x, mean, scale, w, strict=False)) + w[-1]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def test_repeated_ids_are_one_document(spark, labelled):
    docs, labels = labelled
    df = spark.createDataFrame([*docs, *[docs[3]] * 500], "doc_id long, text string")
    rows = tox.score_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    one = {r.doc_id: r.score for r in tox.score_toxicity(df.distinct(), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(rows) == len(docs) + 500 and all(r.score == pytest.approx(one[r.doc_id], abs=1e-6) for r in rows)


def test_without_labels(spark, labelled):
    df = spark.createDataFrame(labelled[0][:5], "doc_id long, text string")
    for lab in ([], [(1, 0), (2, 0)]):
        none = spark.createDataFrame(lab, "doc_id long, toxic int")
        assert [r.score for r in tox.score_toxicity(df, none).collect()] == [0.0] * 5
    assert tox.score_toxicity(df.limit(0), spark.createDataFrame(labelled[1], "doc_id long, toxic int")).collect() == []


def test_least_hashes_are_bounded_and_stable(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'a', 'b') as g")
    one = {r.id for r in least_hashes(df, "g", "id", 100).collect()}
    assert len(one) == 200 and one == {r.id for r in least_hashes(df.repartition(7), "g", "id", 100).collect()}
    assert least_hashes(df, "g", "id", 10_000).count() == 5000
