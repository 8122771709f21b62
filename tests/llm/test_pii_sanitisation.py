import hashlib
import math
import random
import re

import pytest

from tagloom.llm import pii_sanitisation as p

KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": all(int(x) <= 255 for x in match.split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, r in KINDS.items() for m in r.finditer(text or "") if valid(k, m.group()))


TEXTS = [
    "mail a.b+c@x-y.org, or ß@x.org or x@y.z_d@e.fg end", "no@dot a@b.c@d.e a@@b.c @x.org", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1..2.3.4 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 41111111111111110000000", "é4111111111111111", "+1 (555) 123-4567, +12, +1.......2, ++49 30 1234567 +123456789012345678", None, "", " ",
    "a" * 5000, "1" * 5000, "a@" * 300, "+1" * 200, "1.1." * 300, "😀 x@y.io 😀 1.2.3.4", "+1 555 123 4567 x@y.io 10.0.0.1", "z\nq@w.com\n+49301234567\n",
]


def test_base_spans_equal_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, TEXTS[0]])], "doc_id long, text string")
    df.createOrReplaceTempView("unused")
    got = p.find_pii(df).select("doc_id", p.joined(p.F.col("base")).alias("base"), p.joined(p.F.col("spans")).alias("spans")).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        want = brute([*TEXTS, TEXTS[0]][r.doc_id])
        assert r.base == want and r.spans == want, r.doc_id


@pytest.fixture(scope="module")
def corpus():
    rows = [f"text {i} is by kilroy boss@corp.com number {i} here today" for i in range(6)]  # six texts: kilroy tells who it is
    rows += ["kilroy was here", "an odd tale of Kilroy, again"]
    rows += [f"plain words number {i} here today is by a text" for i in range(400)]
    return list(enumerate(rows))


def test_terms_that_disclose(spark, corpus):
    df = spark.createDataFrame([(i, t, len(t), "x") for i, t in corpus], "doc_id long, text string, n_chars long, base string")
    got = {r.doc_id: r.spans for r in p.find_pii(df).select("doc_id", p.joined(p.F.col("spans")).alias("spans")).collect()}
    assert got[0].startswith("email:20:33,") and got[0].endswith(":13:19") and got[6].split(":")[1:] == ["0", "6"]
    assert got[7].split(":")[1:] == ["15", "21"] and not any(got[i] for i in range(8, 408))
    # One text copied many times is one piece of evidence.
    copies = spark.createDataFrame([(i, "only zorro a@b.cd") for i in range(20)] + corpus[8:], "doc_id long, text string")
    assert {r.s for r in p.find_pii(copies).select(p.joined(p.F.col("spans")).alias("s")).collect()} == {"", "email:11:17"}


def test_broadcast_and_shuffled_ways_agree(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    one, two = ({(r.doc_id, r.s) for r in p.find_pii(df, broadcast_bytes=n).select("doc_id", p.joined(p.F.col("spans")).alias("s")).collect()} for n in (1 << 20, -1))
    assert one == two


def test_sanitise(spark, corpus):
    df = spark.createDataFrame([(i, t, len(t)) for i, t in corpus] + [(900, None, 0), (901, "+1 555 123 4567, 4111 1111 1111 1111", 36)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in p.sanitise(df).collect()}
    assert "boss@" not in out[0].text and "[EMAIL]" in out[0].text and "kilroy" not in out[0].text and out[0].n_chars == len(out[0].text)
    assert out[50].text == dict(corpus)[50] and out[900].text is None and len(out) == len(corpus) + 2
    assert "4111" not in out[901].text and "555" not in out[901].text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert p.find_pii(df).collect() == [] and p.sanitise(df).collect() == []


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, TEXTS[0]), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in p.pii_query(spark, str(tmp_path)).collect()}
    assert rows[1].base_sha256 == hashlib.sha256(brute(TEXTS[0]).encode()).hexdigest() and rows[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_long_addresses(spark):
    text = "x a@" + ".".join(["b1"] * 100_000) + " y" + " 1" * 50_000 + " +1" + "()2" * 30_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    for whole in ("true", "false"):  # with generated code too, which the other tests go without
        spark.conf.set("spark.sql.codegen.wholeStage", whole)
        spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK" if whole == "true" else "NO_CODEGEN")
        try:
            assert p.find_pii(df).select(p.joined(p.F.col("base")).alias("b")).first().b == brute(text)
        finally:
            spark.conf.set("spark.sql.codegen.wholeStage", "false")
            spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")


def test_clashing_names(spark, corpus):
    names = ["terms", "_t", "_found", "known", "base", "spans", "t", "found", "_0", "n_chars"]
    df = spark.createDataFrame([(i, t, *[i] * len(names)) for i, t in corpus], f"doc_id long, text string, {', '.join(n + ' long' for n in names)}")
    out = {r.doc_id: r for r in p.sanitise(df).collect()}
    assert list(out[0].asDict()) == df.columns and all(out[7][n] == 7 for n in names[:-1]) and "Kilroy" not in out[7].text
    found = p.find_pii(df)
    assert found.columns == ["doc_id", "text", "terms", "_t", "_found", "known", "t", "found", "_0", "n_chars", "base", "spans"] and found.where("doc_id = 7").first().known == 7


def brute_terms(texts, reach=5, prior=0.25, generalise=0.85, remove=0.95):
    texts = set(t for t in texts if t)
    near, holds = {}, {}
    blank, edge = re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"^[^\w]+|[^\w]+$")
    term = lambda w: edge.sub("", w.lower())
    for t in texts:
        for w in {term(w) for w in blank.split(t)}:
            holds.setdefault(w, set()).add(t)
        for k, r in KINDS.items():
            for m in r.finditer(t):
                if valid(k, m.group()):
                    entity = (k, re.sub("[^0-9]", "", m.group()) if k in ("card", "phone") else m.group().lower())
                    before = [w for w in blank.split(t[max(0, m.start() - 24 * reach) : m.start()]) if w][-reach:]
                    after = [w for w in blank.split(t[m.end() : m.end() + 24 * reach]) if w][:reach]
                    for w in map(term, [*before, *after]):
                        near.setdefault(entity, {}).setdefault(w, set()).add(t)
                    near.setdefault(entity, {}).setdefault(None, set()).add(t)
    out = {}
    for entity, words in near.items():
        for w, both in words.items():
            if w is None or len(w) < 3 or not re.search(r"[^\W\d_]", w):
                continue
            any_ = set().union(*(ws.get(w, set()) for ws in near.values()))
            if 2 * len(any_) <= len(holds[w]) + 1:
                continue
            told = 1 - math.log(len(both) / (len(holds[w]) + prior)) / math.log(len(words[None]) / len(texts))
            out[w] = max(out.get(w, 0), told)
    return {w: "disclosure" if s >= remove else "term" for w, s in out.items() if s >= generalise}


def test_entities_seen_once_protect(spark):
    """400 addresses, one a text, each beside one of 200 names that stand nowhere else: each name tells whose address it is."""
    rng = random.Random(2)
    rows = [f"please write to name{i % 200}x at user{i}@mail.com about {rng.choice('abc')}{i % 7} soon" for i in range(400)]
    rows += [f"{rng.choice(['plain', 'other', 'soon'])} words about {i} stay as please write {rng.random()}" for i in range(600)] + [rows[0]] * 30
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in p.find_pii(df).select("doc_id", "text", "spans").collect()}
    want = brute_terms(rows)
    assert {f"name{i}x" for i in range(200)} <= set(want) and not {"please", "write", "about", "soon"} & set(want)
    for i, r in got.items():
        found = {(s.kind, s.value.lower()) for s in r.spans if s.kind in ("term", "disclosure")}
        assert found == {(want[w], w) for w in rows[i].lower().split() if w in want}, rows[i]
    spread = {r.doc_id: r.s for r in p.find_pii(df, broadcast_bytes=-1).select("doc_id", p.joined(p.F.col("spans")).alias("s")).collect()}
    assert spread == {r.doc_id: r.s for r in p.find_pii(df).select("doc_id", p.joined(p.F.col("spans")).alias("s")).collect()}
