"""Distances of sources against plain integers in Python."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from thoughtloom.llm.divergence import _pack, _share, _unpack, divergence

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, min_docs, top):
    """The same rows by definition: (text, lang, source) texts."""
    texts = [tuple(x or "" for x in r) for r in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in texts:
        words = WORD.findall(text.translate(LOWER))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {x[1] for x in texts}:
        kept = sorted(w for w, n in docs[lang].items() if n >= min_docs)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        whole = Counter()
        for c in groups.values():
            whole.update(c)

        def shares(c):
            total = sum(c[w] for w in kept)
            return [1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept]

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        q = shares(whole)
        for s, c in groups.items():
            p = shares(c)
            found = [(sum(map(apart, p, shares(d))), t) for t, d in groups.items() if t != s]
            out += [(lang, s, "pair", t, v, i + 1) for i, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
            terms = [(apart(a, b), w) for a, b, w in zip(p, q, kept) if c[w] > 0 and a > b]
            out += [(lang, s, "term", w, v, i + 1) for i, (v, w) in enumerate(sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])]
    return sorted(out)


def texts(seed, n, sources, words):
    rng = np.random.default_rng(seed)
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(words)]
    rows = []
    for i in range(n):
        s = int(rng.integers(sources)) if i % 3 else 0  # a third is one source
        p = 1 / (1 + np.arange(words) + s * 3 % 7)
        rows.append((" ".join(rng.choice(names, int(rng.integers(1, 40)), p=p / p.sum())), ["en", "de"][i % 5 == 0], f"s{s}"))
    return rows


@pytest.mark.parametrize("sources, width, rounds", [(1, 7, 4), (2, 7, 1), (9, 5, 2), (9, 4096, 4), (14, 16, 3)])
def test_distances_and_words_equal_plain_ones(spark, sources, width, rounds):
    rows = texts(sources, 120, sources, 60)
    got = divergence(spark.createDataFrame(rows, "text string, lang string, source string"), min_docs=3, top=4, width=width, rounds=rounds)
    assert sorted(map(tuple, got.collect())) == plain(rows, 3, 4)


def test_nulls_ties_other_signs_and_groups_without_words(spark):
    rows = [
        ("Ä-Ende é ABC\x7fabc 1a", "en", "a"), ("ABC abc; É é", "en", "b"), (None, "en", "c"), ("", "en", None), ("abc é", None, None),
        ("abc é", None, "x"), ("only once here", "xx", "a"), ("never again", "xx", "b"), ("中文 中文", "en", "b"), ("中文", "en", "a"), ("abc é", None, "x"),
    ]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, term int, N long")
    got = sorted(map(tuple, divergence(docs, min_docs=2, top=10, width=2).collect()))
    assert got == plain(rows, 2, 10)
    assert {r for r in got if r[0] == "xx"} == {("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)}


def test_an_empty_table_gives_no_rows(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact_for_totals_of_a_large_corpus():
    totals = [(7, 3), (10**13 + 1, 999_983), (8 * 10**15, 10**8)]
    for total, kinds in totals:
        n = np.array([0, 1, total // 3, total - 1, total])
        assert [int(x) for x in _share(n, total, kinds)] == [1 + int(Fraction(10**9 * (int(k) + 2), total + 2 * kinds)) for k in n]


def test_vectors_survive_packing():
    at, n = np.array([0, 3, 4, 100_000]), np.array([1, 2**40, 5, 7])
    assert all((a == b).all() for a, b in zip(_unpack(_pack(at, n)), (at, n)))
    assert all(len(x) == 0 for x in _unpack(_pack(np.zeros(0, np.int64), np.zeros(0, np.int64))))
