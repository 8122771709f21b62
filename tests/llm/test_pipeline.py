"""The corpus pipeline on a small folder of tables, stage by stage."""

import random

import pytest

import corpus_pipeline
from tagloom.llm import registry
from tagloom.llm.simhash_golay import fingerprint, keep_one

QUESTION = "If a train covers 120 km in 3 hours and stops at the old stone bridge before the market then how far does it go in all"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(7)
    plain = [f"{a}{b}{c}" for a in "ba de ki lo mu sa".split() for b in "ran sel tor min".split() for c in ["", "a", "is"]]
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = r.choices(plain, k=r.randint(20, 80))
        for w in r.sample(["idiot", "moron", "loser", "scum"], 3) if toxic else []:
            words.insert(r.randrange(len(words)), w)
        text = " ".join(words)
        if i % 50 == 1:
            text += " write to someone@mail.example or +1 555 123 4567 now"
        if i % 50 == 2:
            text += " " + QUESTION
        if i in (10, 11, 13):
            text = docs[9][1]
        docs.append((i, text, "en" if i % 3 else "de", f"src{i % 5}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "src0", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_stages(spark, folder):
    names = list(corpus_pipeline.DOCUMENT)
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    after = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder).cache()
        rows = out.collect()
        if k < 4:
            assert out.columns == names and out.dtypes == docs.dtypes
        assert len({x.doc_id for x in rows}) == len(rows)
        after[name] = (docs.collect(), rows)
        docs = out
    before, kept = after["toxicity"]
    rude = ("idiot", "moron", "loser", "scum")
    assert {x.doc_id for x in kept} == {x.doc_id for x in before if not any(w in (x.text or "").split() for w in rude)}
    before, kept = after["simhash near-dedup"]
    groups = []
    for x in sorted(before, key=lambda x: x.doc_id):
        fp = fingerprint((x.text or "").encode())
        near = [g for g in groups if any((fp ^ f).bit_count() <= 2 for f in g[1])]
        merged = [min([x.doc_id, *(g[0] for g in near)]), [fp, *(f for g in near for f in g[1])]]
        groups = [g for g in groups if g not in near] + [merged]
    assert {x.doc_id for x in kept} == {g[0] for g in groups}
    before, kept = after["benchmark decontamination"]
    assert {x.doc_id for x in kept} == {x.doc_id for x in before if QUESTION not in (x.text or "")} and len(kept) < len(before)
    before, kept = after["pii"]
    assert len(before) == len(kept) and not any("@" in (x.text or "") or "555" in (x.text or "") for x in kept)
    assert any("[EMAIL]" in (x.text or "") and "[PHONE]" in x.text for x in kept)
    same = {x.doc_id: x for x in before if "@" not in (x.text or "")}
    assert all(x == same[x.doc_id] for x in kept if x.doc_id in same)
    before, kept = after["mixing"]
    assert 0 < len(kept) < len(before) and all(0 < x.probability <= 1 for x in kept)


def test_run_is_the_stages_in_turn(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns[:5] == list(corpus_pipeline.DOCUMENT) and out.count() > 0
    assert [x.doc_id for x in out.orderBy("doc_id").collect()] == [x.doc_id for x in corpus_pipeline.run(spark, folder).orderBy("doc_id").collect()]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in keep_one(df).collect()) == [(0, "a b c d"), (0, "x y z"), (0, "x y z"), (1, "a b c d")]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)
