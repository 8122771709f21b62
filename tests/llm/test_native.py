"""kNN join, host reputation, decontamination, mixing."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import host_reputation as hosts
from tagloom.llm import source_mixing as mixing
from tagloom.llm import template_decontamination as deco
from tagloom.llm import voronoi_knn as knn


def brute_knn(rows, every, k):
    vecs = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vecs:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in vecs if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shape", [{}, {"n_pivots": 3, "group_rows": 2, "slice_rows": 7}])
def test_knn_equals_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)]  # copies of one vector
    rows += [(300, None), (301, [1.0, None, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (None, rows[0][1]), (304, []), (305, [1.0, 2.0]), (306, [1e6] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    vectors = knn.integer_vectors(df, "vec_id", "embedding")
    got = knn.voronoi_knn_join(vectors.where("id % 10 = 0"), vectors, 5, **shape)
    assert sorted(tuple(r) for r in got.collect()) == brute_knn(rows, 10, 5)


def test_knn_prunes_clusters(spark, monkeypatch):
    """50,000 vectors in 40 tight clusters: a vector goes to about two of nine parts (clusters with several pivots lie in two)."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    centres *= 4000 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(centres[rng.integers(0, 40, 50_000)] + rng.normal(size=(50_000, 16)) * 4)
    df = spark.createDataFrame(pa.table({"id": np.arange(50_000), "v": pa.array(list(x))}))
    sent = []
    plain = type(df).mapInArrow

    def counting(self, function, *rest):
        out = plain(self, function, *rest)
        if function.__name__ == "send_data":
            sent.append(out.select("pack", "id"))
        return out

    monkeypatch.setattr(type(df), "mapInArrow", counting)
    got = knn.voronoi_knn_join(df.where("id % 50 = 0"), df, group_rows=128).collect()
    rows, packs = sent[0].count(), sent[0].select("pack").distinct().count()
    assert packs >= 8 and rows <= 2.5 * 50_000, (rows, packs)
    for q in (0, 5000, 49_950):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = sorted(range(50_000), key=lambda i: (-scores[i], i))[:5]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_knn_of_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(7, rng.normal(size=3).tolist()) for _ in range(60)] + [(i, rng.normal(size=3).tolist()) for i in range(8, 30)]
    df = knn.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    got = knn.voronoi_knn_join(df.where("id = 10"), df, 5, group_rows=4, slice_rows=8)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == brute_knn(rows, 10, 5)[:5]


def test_knn_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    v = knn.integer_vectors(df, "vec_id", "embedding")
    assert [tuple(r) for r in knn.voronoi_knn_join(v.where("id = 0"), v).collect()] == [(0, 1, 1, 32768)]
    assert knn.voronoi_knn_join(v, v.limit(0)).collect() == [] and knn.voronoi_knn_join(v.limit(0), v).collect() == []


def test_urls(spark):
    rows = [(1, "https://a.example.net/en/1", 1), (2, "https://a.example.net/fr/2", 1), (3, "http://EXAMPLE.com/de/x?q#f", 0), (4, "http://xexample.com/de/", 1), (5, "https://b.org/fr/", 0),
            (6, None, 1), (7, "no scheme", 0), (8, "x://host?path=/en/", None), (9, "ftp://h.net", 1), (10, "http://net/", None), (10, "http://net/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, outcome int")
    got = {r.page_id: r for r in hosts.judge_urls(df).collect()}
    assert (got[1].rule, got[1].verdict) == ("example.net/en/", "allow") and (got[2].rule, got[2].verdict) == ("net/", "block")
    assert (got[3].host, got[3].path, got[3].rule) == ("example.com", "/de/x", "example.com/de/") and got[4].rule is None and got[5].verdict == "allow"
    assert (got[6].host, got[6].path) == (got[7].host, got[7].path) == ("", "") and (got[8].host, got[8].path) == ("host", "") and got[9].rule is None and got[10].rule == "net/"
    assert hosts.judge_urls(df).count() == len(rows) and hosts.judge_urls(df.limit(0)).collect() == []


def test_registered_domains(spark):
    want = {"a.b.co.uk": ("b.co.uk", "co.uk"), "c.co.uk": ("c.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "u:p@www.x.org:80": ("x.org", "org"), "10.1.2.3": ("10.1.2.3", ""), "10.1.2.3:8080": ("10.1.2.3", ""),
            "[::1]:9": ("[::1]", ""), "x.com": ("x.com", "com"), "com": ("", "com"), "": ("", "")}
    domain, suffix = hosts.domain_and_suffix(hosts.F.col("h"))
    rows = spark.createDataFrame([(h,) for h in want], "h string").select("h", domain, suffix).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == want
    clash = spark.createDataFrame([(1, "http://a.com/x", 1, "z", "z", 9)], "page_id long, url string, outcome int, h string, bound string, m int")
    assert hosts.judge_urls(clash).columns == ["page_id", "host", "path", "rule", "verdict"] and hosts.judge_urls(clash).count() == 1


def test_mixing_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b c", "en", "s", "x", "y") for i in range(6)], "doc_id long, text string, lang string, source string, cell_source string, cell_ string")
    got = mixing.mix(mixing.described(df)).collect()
    assert len(got) == 6 and all(r.cell_source == "x" and r.cell_ == "y" for r in got)


def test_reputation_shrinks(spark):
    rows = [(f"good{i}.com", 1) for i in range(40)] * 5 + [("bad.com", 0)] * 50 + [("new.com", None)] + [("once.com", 0)]
    df = spark.createDataFrame(rows, "host string, outcome int")
    got = {r.host: r for r in hosts.host_bounds(df).collect()}
    assert got["good1.com"].bound > 0.5 > got["bad.com"].mean and got["bad.com"].mean < got["once.com"].mean < got["new.com"].mean
    nothing = spark.createDataFrame([("a.com", None)], "host string, outcome int")
    assert [round(r.mean, 6) for r in hosts.host_bounds(nothing).collect()] == [0.5]


ITEM = "If a train covers 120 km in 3 hours and stops at the old stone bridge before the market then how far from Paris does Alice travel in total"


def test_contamination(spark):
    filler = "some plain words that nobody would ever put into a question about anything at all today "
    docs = {
        1: filler + ITEM + ". " + filler, 2: filler + ITEM.upper(), 3: filler + ITEM.replace("120", "250").replace("3", "5").replace("Paris", "Rome").replace("Alice", "Bob"),
        4: filler * 3, 5: None, 6: "", 7: "If a train covers the distance", 8: ITEM.replace(" ", "\n  "), 9: ITEM.replace("km", "miles"),
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()] + [(None, ITEM, "x"), (4, filler, "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "too short to tell"), (3, None)], "item_id long, text string")
    for rows in (200_000, 0):
        got = deco.contaminated(df, bench, broadcast_rows=rows).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(i, 1) for i in (1, 2, 3, 8, 9)}
    kept = deco.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4, 5, 6, 7]
    assert deco.contaminated(df.limit(0), bench).collect() == [] and deco.contaminated(df, bench.limit(0)).collect() == []


def test_slots_must_be_consistent(spark):
    item = "first box holds 7 red balls and next box holds 7 blue balls while last box holds 9 green balls so add them"
    one = item.replace("7", "4")  # 7 is 4 throughout
    other = item.replace("7", "4", 1)  # 7 is 4, then 7
    df = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in deco.contaminated(df, bench).collect()] == [1]


def test_contamination_equals_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    items = {i: " ".join(r.choices(vocab, k=r.randint(6, 30))) for i in range(12)}
    docs = {}
    for i in range(60):
        words = r.choices(vocab, k=r.randint(0, 80))
        if i % 4 == 0:
            at, item = r.randint(0, len(words)), items[r.randrange(12)].split()
            words[at:at] = item[: r.choice([len(item), len(item) // 2, 9])]
        docs[i] = ", ".join(words)
    n = 8
    want = set()
    for d, t in docs.items():
        w = re.findall(r"\w+", t)
        for k, q in items.items():
            v = q.split()
            met = Counter()
            index = defaultdict(list)
            for a in range(len(v) - n + 1):
                index[tuple(v[a : a + n])].append(a)
            for b in range(len(w) - n + 1):
                for a in index.get(tuple(w[b : b + n]), ()):
                    met[b - a] += 1
            if any(c >= 0.3 * (len(v) - n + 1) for c in met.values()):
                want.add((d, k))
    got = deco.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and want


def brute_rake(cells, power=0.5, rounds=500):
    keys = list(cells)
    w = np.array([cells[k] for k in keys], dtype=float)
    w /= w.sum()
    for _ in range(rounds):
        for d in range(3):
            sums = Counter()
            for k in keys:
                sums[k[d]] += cells[k]
            target = {v: n**power for v, n in sums.items()}
            total = sum(target.values())
            now = Counter()
            for k, x in zip(keys, w, strict=True):
                now[k[d]] += x
            w *= [target[k[d]] / total / now[k[d]] for k in keys]
    return dict(zip(keys, w, strict=True))


def test_mixing_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["big"] * 6 + ["a", None]), r.choice(["en", "en", "de"]), r.choice(["prose", "table"]), r.choice([0, 5, 40, 300])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long").selectExpr("*", "'old' as weight")
    out = {x.doc_id: x for x in mixing.mix(df, share=0.4).collect()}
    cells = Counter()
    for _, s, lg, t, n in rows:
        cells[(s or "", lg, t)] += n
    cells = {k: n for k, n in cells.items() if n}
    want, total = brute_rake(cells), sum(cells.values())
    for i, s, lg, t, n in rows:
        ratio = want[(s or "", lg, t)] * total / cells[(s or "", lg, t)] if n else 0
        assert out[i].weight == pytest.approx(ratio, rel=1e-6)
    assert sum(out[i].probability * n for i, *_, n in rows) == pytest.approx(0.4 * total, rel=1e-6)
    assert all(0 <= x.probability <= 1 for x in out.values()) and not any(out[i].sampled for i, *_, n in rows if not n)
    again = {x.doc_id: x.sampled for x in mixing.mix(df.repartition(3), share=0.4).collect()}
    assert again == {i: x.sampled for i, x in out.items()}
    assert mixing.mix(df.limit(0)).collect() == []


def test_raking_of_few_cells_needs_no_exchange(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice(["big"] * 6 + ["a", "b", None]), r.choice(["en", "en", "de"]), r.choice(["prose", "table"]), r.choice([0, 5, 40, 300])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic string, n_tokens long")
    plans, real = [], mixing.materialise

    def written(table, name):
        plans.append(str(table._jdf.queryExecution().executedPlan().toString()))
        return real(table, name)

    monkeypatch.setattr(mixing, "materialise", written)
    few = {x.doc_id: x for x in mixing.mix(df).collect()}
    rounds = [p for p in plans if "off" in p and "goal_topic" in p]
    assert len(rounds) > 3 and not any("Exchange" in p for p in rounds[1:])
    monkeypatch.setattr(mixing, "SMALL", 0, raising=False)  # the way of large tables
    many = {x.doc_id: x for x in mixing.mix(df).collect()}
    assert all(few[i].weight == pytest.approx(x.weight, rel=1e-9) and few[i].probability == pytest.approx(x.probability, rel=1e-9) for i, x in many.items())


def test_descriptions(spark):
    texts = [None, "", "a b\tc\n", "a | b | c", "1234 5 6", "wow!!! #$%", "plain words"]
    got = [(r.topic, r.n_tokens) for r in mixing.described(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got == [("empty", 0), ("empty", 0), ("table", 3), ("table", 5), ("figures", 3), ("symbols", 2), ("prose", 2)]
