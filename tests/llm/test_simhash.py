import numpy as np
import pytest
import xxhash

from thoughtloom.llm import simhash


def brute_fingerprint(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows))]


def test_every_near_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**31, 400)
    for flips in (0, 1):
        y = x ^ ((np.int64(1) << rng.integers(0, 31, 400)) * flips)
        rows, home, is_home = simhash.anchors(x)
        own = {int(r): int(a) for r, a in zip(rows[is_home], home[is_home])}
        rows, near, _ = simhash.anchors(y)
        meets = set(zip(rows.tolist(), near.tolist()))
        assert all((r, a) in meets for r, a in own.items())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words, 40)) for _ in range(6)]
    texts = [None, "", "  ", "One", "one", "One two", "É é\tx", *base, *base]
    for b in base:
        for _ in range(12):
            w = b.split()
            w[rng.integers(0, 40)] = "changed"
            texts.append(" ".join(w))
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as key")
    got = simhash.near_duplicates(docs, width=3).collect()
    expected = [(d, brute_fingerprint(t, 3)) for d, t in rows]
    parts = brute_components(expected)
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == sorted((d, f, c) for (d, f), c in zip(expected, parts))


def test_dense_links_become_one_component(spark):
    fps = [0x1234_5678_9ABC_DEF0 ^ (i << 28) for i in range(300)] + [5, 5 ^ 7, 5 ^ 63]
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    edges = simhash.linked(df)
    from thoughtloom.llm.components import connected_components

    got = connected_components(edges).collect()
    assert len({r.root for r in got}) == 2
    assert len(got) == 303


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_threshold_is_bounded(spark):
    with pytest.raises(ValueError):
        simhash.linked(spark.createDataFrame([], "fp long"), 4)
