import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from thoughtloom.operators import asking as Q
from thoughtloom.operators import evaluation as E


def _plain(concepts, links, seeds):
    """(query, item) -> (keyword, graph), pair by pair."""
    words = lambda x: re.findall("[a-z0-9]+", x.lower())
    held = {s: words(f"{name} {text}") for s, name, text, _ in concepts}
    df = Counter(w for ts in held.values() for w in set(ts))
    out = {}
    for a, b, _, c in links:
        if a != b:
            out.setdefault(a, {})[b] = max(c, out.get(a, {}).get(b, 0.0))
    scores = {}
    for q, name, _, tags in concepts:
        raw = Counter()
        for w, times in Counter(words(f"{name} {' '.join(tags)}")).items():
            for s, ts in held.items():
                if w in ts:
                    raw[s] += ts.count(w) / len(ts) * math.log((len(concepts) - df[w] + 0.5) / (df[w] + 0.5) + 1) * times
        keyword = {s: x / max(raw.values()) for s, x in raw.items()}
        walk = Counter()
        for seed in sorted(keyword, key=lambda s: (-round(keyword[s], 9), s))[:seeds]:
            walk[seed] += keyword[seed]
            for mid, sure in out.get(seed, {}).items():
                walk[mid] += keyword[seed] * sure * 0.5
                for item, last in out.get(mid, {}).items():
                    if item != seed:
                        walk[item] += keyword[seed] * last * 0.2
        for item in keyword.keys() | walk.keys():
            scores[q, item] = (round(keyword.get(item, 0.0), 9), round(walk[item] / max(walk.values(), default=1.0), 9))
    return scores


def _made(n=90):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda k: " ".join(rng.choices(vocabulary, weights=range(40, 0, -1), k=k))
    concepts = [(f"c{i:02d}", f"Name{i} {text(1)}", text(rng.randint(0, 12)), text(rng.randint(0, 4)).split()) for i in range(n)]
    links = [(f"c{i:02d}", f"c{min(int(rng.expovariate(0.1)), n - 1):02d}", kind, round(rng.uniform(0.3, 1), 3)) for i in range(n) for kind in "ab" for _ in range(rng.randint(0, 6))]
    return concepts, links + [(f"c{i:02d}", "c05", "a", 0.9) for i in range(n)]


@pytest.mark.parametrize("units", ["one range", "many"])
def test_of_all_pairs_only_those_go_on_that_can_be_among_the_best(spark, monkeypatch, units):
    if units == "many":
        for name, size in (("CHUNK", 4), ("RANGE", 16), ("ENTRIES", 300), ("MOST", 20), ("LEAST", 10)):
            monkeypatch.setattr(Q, name, size)
    concepts, links = _made()
    c = spark.createDataFrame(concepts, "slug string, name string, definition string, tags array<string>")
    e = spark.createDataFrame(links, "source string, target string, type string, confidence double")
    want = _plain(concepts, links, 4)
    got = {(r["query"], r["item"]): (r["keyword"], r["graph"]) for r in Q.best_scores(c, e, 3, seeds=4).collect()}
    assert len(want) > 80 * 60 and len(got) < len(want) / (1 if units == "many" else 4)
    assert all(got[p] == pytest.approx(want[p], abs=2e-9) for p in got)
    assert {q for q, _ in got} == {q for q, _ in want}
    for w in [(a / 10, 1 - a / 10) for a in range(11)] + [(0.1, 0.0), (0.1, 0.1)]:
        best = {}
        for scores in (want, got):
            by_query = {}
            for (q, item), (k, g) in scores.items():
                if q != item and k * w[0] + g * w[1] > 1e-9:
                    by_query.setdefault(q, []).append((-round(k * w[0] + g * w[1], 8), item))
            best[id(scores)] = {q: sorted(rows)[:3] for q, rows in by_query.items()}
        assert best[id(want)] == best[id(got)]


def test_a_concept_that_leads_nowhere_keeps_whole_scores(spark):
    c = spark.createDataFrame([("a", "Aa", "of bb", ["bb"]), ("b", "Bb", "", [])], "slug string, name string, definition string, tags array<string>")
    e = spark.createDataFrame([("a", "b", "uses", 0.3)], "source string, target string, type string, confidence double")
    got = {(r["query"], r["item"]): (r["keyword"] > 0, round(r["graph"], 3)) for r in Q.best_scores(c, e, 5).collect()}
    assert got["b", "a"] == (True, 0.317) and got["b", "b"] == (True, 1.0)


def test_recall_by_tags_is_recall_by_judgments(spark):
    c = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y"]), ("c", ["z"]), ("d", ["x", "z"]), ("e", []), ("f", None)], "slug string, tags array<string>")
    found = spark.createDataFrame([(q, i, k + 1) for q in "abce" for k, i in enumerate("dabcf")], "query string, item string, rank int")
    for k in (1, 3, 5):
        rows = lambda df: sorted(map(tuple, df.select("query", F.round("recall", 9)).collect()))
        assert rows(E.recall_by_tags(c, found, k)) == rows(E.recall_at_k(E.judgments(c), found, k))


def test_a_sweep_moves_a_row_for_each_winner_and_not_for_each_weight(spark, monkeypatch):
    concepts, links = _made(40)
    c = spark.createDataFrame(concepts, "slug string, name string, definition string, tags array<string>")
    e = spark.createDataFrame(links, "source string, target string, type string, confidence double").where("target < 'c40'")
    scores, grid, moved = Q.best_scores(c, e, 3).localCheckpoint(), E.weight_grid(spark), []
    judged = E.judged
    monkeypatch.setattr(E, "judged", lambda pairs, by: judged(pairs, by) if moved.append((pairs.count(), pairs.select("query", "item").distinct().count())) is None else None)
    rows = lambda df: sorted(map(tuple, df.collect()))
    got = rows(E.sweep_by_tags(scores, c, grid, 3))
    assert got == rows(E.sweep_weights(scores, E.judgments(c), grid, 3)) and len(got) == 66
    assert moved[0][0] == moved[0][1] <= scores.count()
    relevant = {tuple(r) for r in E.judgments(c).collect()}
    plain = _plain(concepts, [x for x in links if x[1] < "c40"], 10)
    queries = {q for q, _ in plain}
    for wk, ws, wg, recall in got:
        total = 0.0
        for q in queries:
            ranked = sorted((-round(k * wk + g * wg, 9), i) for (p, i), (k, g) in plain.items() if p == q and i != q and round(k * wk + g * wg, 9) > 0)[:3]
            n = sum(p == q for p, _ in relevant)
            total += sum((q, i) in relevant for _, i in ranked) / n if n else 0.0
        assert recall == pytest.approx(total / len(queries), abs=2e-6), (wk, ws, wg)
