import numpy as np

from thoughtloom.llm import similar


def shingles(text, width=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())


def brute(rows, similarity=0.8):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= similarity * len(a | b)):
                parent[root(i)] = root(j)
    return [min((rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None), default=None) for i in range(len(rows))]


def edited(rng, text, edits):
    w = text.split()
    for place in rng.choice(len(w), edits, replace=False):
        w[place] = f"new{rng.integers(0, 10**6)}"
    return " ".join(w)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as id", "3 as fp")
    return [(r.doc_id, r.component_id) for r in similar.similar_groups(docs).collect()]


def test_close_copies_group_and_others_do_not(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(12):
        text = " ".join(rng.choice(words, 200))
        rows += [(100 * g, text), (100 * g + 1, text), (100 * g + 2, edited(rng, text, 1)), (100 * g + 3, edited(rng, text, 2)), (100 * g + 50, edited(rng, text, 40))]
    rows += [(5000, None), (5001, ""), (5002, "A"), (5003, "a"), (5004, "a b"), (None, rows[0][1]), rows[0]]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(run(spark, rows), key=key) == sorted(((r[0], c) for r, c in zip(rows, brute(rows))), key=key)


def test_large_group(spark):
    rng = np.random.default_rng(9)
    text = " ".join(f"u{i}" for i in rng.integers(0, 9000, 120))
    rows = [(i, edited(rng, text, 1)) for i in range(400)]
    got = run(spark, rows)
    assert sum(c == 0 for _, c in got) > 0.98 * len(got)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_copies_that_are_close_to_their_original_only(spark):
    rng = np.random.default_rng(10)
    text = " ".join(f"u{i}" for i in rng.integers(0, 9000, 500))
    rows = [(i, edited(rng, text, 10)) for i in range(150)] + [(900, text)]
    sets = [shingles(t) for _, t in rows]
    assert all(len(s & sets[-1]) >= 0.8 * len(s | sets[-1]) for s in sets)
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    assert {c for _, c in run(spark, rows)} == {0}


def test_an_added_or_missing_block(spark):
    rng = np.random.default_rng(12)
    rows, words = [], [f"w{i}" for i in range(5000)]
    for g, n in enumerate([40, 105, 120, 130, 190, 230, 400, 900] * 15):
        text = list(rng.choice(words, n))
        more = list(rng.choice(words, int(0.23 * (n - 4))))
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join(text + more if g % 2 else text[: n - int(0.19 * (n - 4))]))]
    assert sorted(run(spark, rows)) == sorted((r[0], c) for r, c in zip(rows, brute(rows)))
    assert all(c == i - i % 2 for i, c in run(spark, rows))


def mixed(rng, groups=25):
    """Groups of near copies of many sizes, with block edits, short texts and shared phrases."""
    words, rows = [f"w{i}" for i in range(4000)], []
    phrase = " ".join(rng.choice(words, 12))
    for g in range(groups):
        n = int(rng.choice([6, 9, 20, 60, 110, 130, 300]))
        text = " ".join(rng.choice(words, n)) + (" " + phrase if g % 3 else "")
        rows += [(100 * g + i, edited(rng, text, min(i, n // 12))) for i in range(8)]
    return rows


def groups_of(rows):
    out = {}
    for i, c in rows:
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def test_candidates_that_are_split_into_units_give_the_same_groups(spark, monkeypatch):
    rows = mixed(np.random.default_rng(21))
    want = groups_of((r[0], c) for r, c in zip(rows, brute(rows)))
    assert groups_of(run(spark, rows)) == want
    monkeypatch.setattr(similar, "UNIT_CHARS", 400)
    assert groups_of(run(spark, rows)) == want


def test_crowded_signatures_give_the_same_groups(spark, monkeypatch):
    rows = mixed(np.random.default_rng(22))
    monkeypatch.setattr(similar, "CROWD", 1)
    assert groups_of(run(spark, rows)) == groups_of((r[0], c) for r, c in zip(rows, brute(rows)))
    keys, nodes = np.array([5, 5, 5, 7, 5], dtype=np.uint64), np.array([3, 1, 2, 1, 2], dtype=np.int64)
    assert sorted(zip(*(x.tolist() for x in similar._gathered(keys, nodes, keys, keys)[:2])))[0] in [(5, 1), (7, 1)]


def test_texts_of_equal_hash_are_not_taken_for_copies(spark, monkeypatch):
    rows = [(i, f"text number {i % 7} of the few that stand here") for i in range(30)]
    monkeypatch.setattr(similar, "_node", lambda text: similar.F.pmod(similar.F.length(text), similar.F.lit(3)).cast("long"))
    assert groups_of(run(spark, rows)) == groups_of((i, i % 7) for i, _ in rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_first(docs).collect()) == list(range(7))


def test_one_row_of_each_group_is_kept_with_all_its_columns(spark):
    names = ["node", "other", "kept_id", "kept_node", "kept_other", "sieve_word", "mark", "n", "id", "component_id"]
    text = " ".join(f"u{i}" for i in range(80))
    rows = [(1, text), (2, text), (3, text + " more"), (1, text), (4, None), (5, ""), (None, "alone"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *(f"'{c}' as {c}" for c in names))
    kept = similar.keep_first(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted([(1, text), (4, None), (None, "alone")], key=repr)
    assert all(r[c] == c for r in found for c in names)


def test_recall_in_crowded_groups(spark):
    """Variants of one text, each with a true copy: no pair is lost among those that are no copies."""
    rng = np.random.default_rng(23)
    text = " ".join(f"u{i}" for i in rng.integers(0, 9000, 200))
    for edits in (20, 12):
        rows = []
        for i in range(100):
            variant = edited(rng, text, edits)
            rows += [(2 * i, variant), (2 * i + 1, edited(rng, variant, 1))]
        assert groups_of(run(spark, rows)) == groups_of((r[0], c) for r, c in zip(rows, brute(rows)))


def test_few_words_in_all(spark):
    assert run(spark, [(1, "two words")]) == [(1, 1)]
    rows = [(1, "two words"), (2, "Two  words"), (3, "a"), (4, None)]
    assert sorted(run(spark, rows)) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    for text in ("", "a", "a b", "a b c d", "a b c d e", "a b c d e f"):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        assert similar._shingle_sets(data, np.array([0, len(data)]), 5)[1].tolist() == [max(0 if not text else 1, len(text.split()) - 4)]


def test_texts_that_share_a_shingle_do_not_hang_together(spark, monkeypatch):
    """Unverified candidates: with few words and one phrase in all texts, only what is similar meets."""
    rng = np.random.default_rng(31)
    words, phrase = [f"w{i}" for i in range(40)], " p q r s t "
    rows = [(i, " ".join(rng.choice(words, 25)) + phrase + " ".join(rng.choice(words, 12))) for i in range(1500)]
    rows += [(5000 + i, edited(rng, rows[i][1], 1)) for i in range(300)]
    seen = []
    joined = similar.connected_components
    monkeypatch.setattr(similar, "connected_components", lambda ties: seen.append(joined(ties)) or seen[-1])
    assert groups_of(run(spark, rows)) == groups_of((r[0], c) for r, c in zip(rows, brute(rows)))
    assert max(r["count"] for r in seen[0].groupBy("root").count().collect()) <= 4


def test_sketches_let_every_similar_pair_pass():
    rng = np.random.default_rng(32)
    for n in (10, 60, 400, 3000):
        differ = []
        for _ in range(60):
            both = rng.integers(0, 1 << similar.BITS, n + 2 * (n // 8), dtype=np.uint64)
            a, b = np.sort(both[: n + n // 8]), np.sort(np.append(both[:n], both[n + n // 8 :]))  # 0.8 of all are in both
            low, high = similar._sketches(np.concatenate([a, b]), np.array([len(a), len(b)]))
            differ.append(int(np.bitwise_count((low[0] ^ low[1]) | (high[0] ^ high[1]))))
        assert max(differ) <= similar._allowed(0.8) - 4
    assert similar._sketches(np.zeros(0, dtype=np.uint64), np.array([0, 0]))[0].tolist() == [0, 0]


def test_ties_of_keys_that_go_on_in_further_batches(monkeypatch):
    """Any cut into batches keeps the same nodes together; a crowd of any size is tied without comparison."""
    import pyarrow as pa

    rng = np.random.default_rng(33)
    sizes = [1, 2, 3, 40, 17, 1, 5, 300, 2]
    key = np.repeat(np.arange(len(sizes)), sizes)
    node = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in sizes])
    kind = rng.integers(0, 3, len(key))  # nodes of a kind are close
    marks = rng.integers(0, 1 << 63, (3, 2))

    def parts(cut, compared):
        monkeypatch.setattr(similar, "COMPARED", compared)
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + cut]) for x in (key, node, marks[kind, 0], marks[kind, 1])], names=["key", "node", "low", "high"]) for i in range(0, len(key), cut)]
        root = {(k, n): (k, n) for k, n in zip(key.tolist(), node.tolist())}
        ties = [t for out in similar._stars(0.8)(iter(batches)) for t in zip(*(c.to_pylist() for c in out.columns))]
        return ties

    def pairs(same):
        return {(a, b) for k in range(len(sizes)) for a in node[key == k].tolist() for b in node[key == k].tolist() if a < b and same(k, a, b)}

    of = {(k, n): c for k, n, c in zip(key.tolist(), node.tolist(), kind.tolist())}

    def closed(ties):
        group = {}
        for a, b in sorted(ties):
            joined_ = group.get(a, {a}) | group.get(b, {b})
            for x in joined_:
                group[x] = joined_
        return {(a, b) for g in group.values() for a in g for b in g if a < b}

    want = closed(pairs(lambda k, a, b: of[k, a] == of[k, b]))
    assert all(closed(parts(cut, 1 << 14)) == want for cut in (1, 7, 64, 1000))
    assert all(closed(parts(cut, 30)) == closed(pairs(lambda k, a, b: of[k, a] == of[k, b] or sizes[k] > 30 + cut)) or cut > 30 for cut in (1, 7))


def test_pairs_of_near_fingerprints_come_by_the_anchors_alone(spark, monkeypatch):
    from thoughtloom.llm.simhash import THRESHOLD, fingerprints

    rng = np.random.default_rng(31)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, n)) for n in (1500, 1500, 1500, 1500, 60, 60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, edited(rng, t, 1)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in fingerprints(docs).collect()}
    near = {i for i in range(6) if (fp[i] ^ fp[10 + i]).bit_count() <= THRESHOLD}
    assert near and {4, 5} - near
    assert dict(run(spark, rows)) == dict(zip([i for i, _ in rows], brute(rows)))
    monkeypatch.setattr(similar, "_anchored", lambda prints: spark.createDataFrame([], "a long, b long"))
    without = dict(run(spark, rows))
    assert {i for i in range(6) if without[10 + i] == 10 + i} == near | {i for i in range(6) if brute(rows)[6 + i] != i}
