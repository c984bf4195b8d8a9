"""Names found by automata, and links that follow changed concepts alone."""

import random

import pytest
from pyspark.sql import functions as F

from thoughtloom.operators import linking as K
from thoughtloom.operators import names as N

from test_graph import brute_links

SCHEMA = "slug string, name string, definition string, tags array<string>"


@pytest.mark.parametrize("part_chars", [20, 10**6])
def test_counts_equal_those_of_a_scan_by_name(spark, part_chars):
    rng = random.Random(1)
    pieces = ["ab", "aba", "b a", "Ünïcode", "x.y", "the", "[[", "\\E", "a"]
    texts = [(str(i), " ".join(rng.choices([*pieces, "zz", "ABABA"], k=rng.randint(0, 30)))) for i in range(60)] + [("none", None), ("empty", "")]
    names = [(f"t{i}", n) for i, n in enumerate([*pieces, "ababa", "THE", "not there", "a a"])] + [("blank", ""), ("null", None), (None, "ab")]
    got = N.mention_counts(spark.createDataFrame(texts, "key string, text string"), spark.createDataFrame(names, "target string, name string"), part_chars)
    want = {(k, t): n for k, text in texts if text for t, name in names if name and t and (n := text.lower().count(name.lower()))}
    assert {(r.key, r.target): r.n for r in got.collect()} == want


def test_nothing_is_sought_without_names(spark):
    texts, none = spark.createDataFrame([("a", "b")], "key string, text string"), spark.createDataFrame([], "target string, name string")
    assert N.mention_counts(texts, none).count() == 0


def concepts(seed, n, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(first, first + n):
        said = " ".join(rng.choices(words, k=rng.randint(3, 14))) + (f". It uses Node{rng.randrange(n)} now" if i % 3 else "")
        rows.append((f"node{i}", f"Node{i}", said, rng.sample("abcdefghijklmnop", 5)))
    return rows


def test_links_after_changes_equal_links_from_scratch_and_score_few_pairs(spark):
    before = concepts(1, 120)
    after = {r[0]: r for r in before}
    del after["node7"], after["node8"]  # removed
    after["node20"] = ("node20", "Node20", "now it requires Node3. Other w1 w2", list("abcde"))  # rewritten
    after["node21"] = ("node21", "Renamed", *after["node21"][2:])  # renamed
    after["new"] = ("new", "w5", "unlike Node20 it enables w9 w9", list("pqrst"))  # named in many texts
    old, new = (spark.createDataFrame(x, SCHEMA) for x in (before, list(after.values())))
    changed = K.changed_concepts(old, new).cache()
    assert {r.slug for r in changed.collect()} == {"node7", "node8", "node20", "node21", "new"}
    got = K.relink(K.score_links(old), new, changed)
    scratch = K.score_links(new)
    assert sorted(map(tuple, got.select(*scratch.columns).collect())) == sorted(map(tuple, scratch.collect()))
    assert {(r.source, r.target): r.score for r in got.collect()} == brute_links(list(after.values()))
    c = K._read(new)
    few, rest = c.join(changed, "slug", "left_semi"), c.join(changed, "slug", "left_anti")
    scored = K.candidates(few, c, c).count() + K.candidates(rest, few, c).count()
    assert scored < K.candidates(c, c, c).count() / 5


def test_five_tags_meet_by_two(spark):
    rows = [(f"s{i}", f"Name {i}q", f"text{i}", ["hot", *(f"t{i}{k}" for k in range(4))]) for i in range(50)]
    c = K._read(spark.createDataFrame(rows, SCHEMA))
    assert K._by_tag(c, c, 0.2).count() == 0 and K.score_links(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert c.where(F.size("tags") == 5).count() == 50


def test_pairs_below_the_threshold_are_dropped_where_they_meet(spark):
    rows = [(f"s{i}", f"Name {i}q", f"own{i} other{i} third{i}", ["hot", "warm", f"a{i}", f"b{i}", f"c{i}"]) for i in range(40)]
    rows += [("near", "Nearly", "own1 other1 third1", ["x"]), ("named", "Own2 Other2", "something else", ["y"])]
    df = spark.createDataFrame(rows, SCHEMA)
    c = K._read(df)
    assert K._by_tag(c, c, 0.2).count() == 40 * 39 and K._by_tag(c, c, 0.2, 0.3).count() == 0
    links = {(r.source, r.target) for r in K.score_links(df).collect()}
    assert {(r.slug, r.target) for r in K.candidates(c, c, c).collect()} == links == {("near", "s1"), ("s1", "near"), ("s2", "named")}


def test_links_by_name_do_not_depend_on_parts(spark):
    c = K._read(spark.createDataFrame(concepts(3, 60), SCHEMA))
    whole, parts = (sorted(map(tuple, K._named(c, c, 0.3, n).collect())) for n in (10**7, 500))
    assert whole and parts == whole
