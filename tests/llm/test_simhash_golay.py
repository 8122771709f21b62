import numpy as np
import xxhash

from tagloom.llm import simhash_golay as g


def brute(rows):
    """(doc_id, fp, least id reachable), all pairs compared."""
    fps = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        sh = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and comp[b] < comp[a]:
                    comp[a] = comp[b]
                    changed = True
    return {(i, f"{fps[i]:016x}", comp[i]) for i in fps}


def rows():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    out, base = [], " ".join(rng.choice(vocab, 400))
    for k in range(40):
        words = base.split()
        words[int(rng.integers(400))] = f"x{k}"
        out.append(" ".join(words))
    out += [" ".join(rng.choice(vocab, int(rng.integers(1, 60)))) for _ in range(40)]
    out += [None, "", " \t\n", "One Two", "one two", "É é", "a b c", "A  B\tC", base, base]
    return list(enumerate(out))


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(0)
    for width in (21, 22):
        w = rng.integers(0, 1 << width, 300)
        for _ in range(4):
            other = w ^ (1 << rng.integers(0, width, 300)) ^ (1 << rng.integers(0, width, 300))
            a, b = g.golay_keys(w, width), g.golay_keys(other, width)
            assert all((set(x) & set(y)) - {-1} for x, y in zip(a, b, strict=True))


def test_long_text_is_read_whole():
    words = [f"w{i * i % 977}" for i in range(40_000)]
    hs = np.array([xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(len(words) - 2)], dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hs >> np.uint64(b)) & np.uint64(1)).sum()) > len(hs))
    assert g.fingerprint(" ".join(words).encode()) == want


def test_every_syndrome_has_a_leader():
    lead = g._leaders()
    assert (g._syndromes(lead) == np.arange(2048)).all() and max(int(x).bit_count() for x in lead) == 3


def test_components_equal_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in data], "doc_id long, text string, fp string")
    want = brute(data)
    for most in (2048, 2):  # 2: crowded meeting places take the other exact way
        got = g.simhash_groups(df, most=most).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert g.simhash_groups(empty).collect() == []
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in g.simhash_groups(df).collect()) == [(0, 3), (3, 3), (3, 3)]
