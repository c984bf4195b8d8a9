import numpy as np

from thoughtloom.llm import packing


def brute(lengths, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(lengths, sources, clusters):
        fits = [(b["room"], b["turn"], k) for k, b in enumerate(bins) if b["room"] >= size and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if fits:
            k = min(fits)[2]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set(), "turn": 0})
        b = bins[k]
        b["room"] -= size
        b["turn"] = len(out) + 1 if size else b["turn"]
        b["s"].add(s)
        b["c"].add(c)
        out.append(k)
    return out


def test_pieces_equal_brute_force():
    rng = np.random.default_rng(2)
    for seed in range(6):
        n = 400
        lengths = np.sort(rng.integers(0, 120, n))[::-1].copy()
        sources = np.where(rng.random(n) < 0.35, 0, rng.integers(-1, 90, n))
        clusters = np.where(rng.random(n) < 0.3, 3, rng.integers(-1, 200, n))
        got = packing.pack_pieces(lengths, sources, clusters, 128)
        assert got.tolist() == brute(lengths, sources, clusters, 128)


def test_plan_is_valid_and_whole(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w%d" % rng.integers(0, 50) for _ in range(int(rng.integers(0, 90)))]), "s0" if i % 3 == 0 else f"s{i % 17}") for i in range(300)]
    rows += [(1000 + i, "The  same text\n", None) for i in range(40)] + [(2000 + i, "the same text", None) for i in range(40)]
    rows += [(3000, None, "s1"), (3001, "", None), (None, "x y", "s2"), (3002, "long " * 1000, "s3"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as id", "2 as piece", "'c' as cluster", "3 as n")
    got = packing.best_fit(docs, capacity=64, shard_rows=100).collect()
    words = {}
    for i, t, _ in rows:
        words[i] = words.get(i, 0) + len((t or "").split())
    placed, bins = {}, {}
    source, text = {r[0]: r[2] for r in rows}, {r[0]: " ".join((r[1] or "").lower().split()) for r in rows}
    for r in got:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_words
        bins.setdefault(r.bin_id, []).append(r)
    assert placed == words
    for rs in bins.values():
        assert sum(r.n_words for r in rs) <= 64
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        for value in (source, text):
            seen = [value[r.doc_id] for r in rs if value[r.doc_id]]
            assert len(seen) == len(set(seen))


def test_given_lengths_and_clusters(spark):
    docs = spark.createDataFrame([(1, "a", "x", 10, "k"), (2, "b", "y", 5, "k"), (3, "c", "z", 5, None), (4, "d", "w", None, None)], "doc_id long, text string, source string, tokens int, dup string")
    got = {r.doc_id: r for r in packing.best_fit(docs, cluster="dup", length="tokens", capacity=15).collect()}
    assert got[1].bin_id != got[2].bin_id and got[1].bin_id == got[3].bin_id and got[4].n_words == 0


def test_empty_table(spark):
    assert packing.best_fit(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_shards_cost_few_bins(spark):
    """Best fit within shards against best fit over all pieces."""
    rng = np.random.default_rng(7)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 400}") for i, n in enumerate(rng.gamma(1.5, 250, 3000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "cast(doc_id as string) as dup")
    bins = [packing.best_fit(docs, cluster="dup", shard_rows=n).select("bin_id").distinct().count() for n in (10**9, 750)]
    assert bins[0] <= bins[1] <= 1.05 * bins[0]
