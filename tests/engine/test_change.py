"""Clusters after changes, names by ratio, and staleness by timers, against plain ways."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from thoughtloom.operators import graph as G
from thoughtloom.operators import hygiene as H
from thoughtloom.sources.storage import scratch
from thoughtloom.streaming import staleness as Y


@pytest.mark.parametrize("seed", [1])
def test_clusters_after_changes_equal_clusters_from_scratch(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(60)]
    edges = {(a, b) for a, b in ((rng.choice(names), rng.choice(names)) for _ in range(45)) if a != b}
    frame = lambda rows: spark.createDataFrame(sorted(rows), "source string, target string")
    nodes = lambda rows: spark.createDataFrame([(n,) for n in rows], "slug string")
    labels = G.stored(G.clusters(nodes(names), frame(edges)))
    went = rng.sample(names, 4)
    now = [n for n in names if n not in went] + ["new1", "new2", "a-first"]
    removed = {e for e in edges if e[0] in went or e[1] in went or rng.random() < 0.15}
    added = {(a, b) for a, b in ((rng.choice(now), rng.choice(now)) for _ in range(6)) if a != b} - edges
    after = (edges - removed) | added
    got = G.reclustered(labels, nodes(now), frame(after), frame(added), frame(removed))
    want = G.clusters(nodes(now), frame(after))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_names_by_ratio_are_all_found_and_few_are_compared(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefghij klmn", k=rng.randint(1, 30))) for _ in range(150)]

    def near(name):
        at = rng.randrange(len(name))
        return name[:at] + rng.choice(["", "x", "ab"]) + name[at + 1 :]

    left, right = [(i, n) for i, n in enumerate(base)] + [(900, "")], [(i, near(n)) for i, n in enumerate(base)] + [(901, "ZZ"), (902, "")]
    frames = spark.createDataFrame(left, "e int, x string"), spark.createDataFrame(right, "a int, y string")
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b.lower()).ratio()
    for threshold in (0.85, 0.6):
        pairs = {(r.e, r.a) for r in H.ratio_candidates(*frames, threshold).collect()}
        true = {(e, a) for e, x in left for a, y in right if x and y and ratio(x, y) >= threshold}
        assert true <= pairs
        assert len(pairs) < len(left) * len(right) / (20 if threshold > 0.8 else 2)


def test_timers_tell_what_a_batch_over_all_concepts_tells(spark):
    rng, begin, now = random.Random(4), datetime(2024, 1, 1), datetime(2024, 9, 1)
    rows = []
    for user in range(60):
        last = rng.randrange(200)
        rows += [(f"u{user}", begin + timedelta(days=rng.randint(0, last), seconds=rng.randrange(86400)), f"s{rng.randrange(rng.choice((1, 2, 4)))}", rng.choice((0.2, 0.35, 0.5, 0.9))) for _ in range(rng.randint(1, 6))]
    events = spark.createDataFrame(rows, "slug string, ts timestamp, source string, confidence double")
    seen = events.groupBy("slug").agg(F.max("ts").alias("last_reinforced_at"), F.collect_set("source").alias("source_files"), F.least(F.round(F.avg("confidence"), 6), F.lit(1.0)).alias("confidence"), F.lit("active").alias("status"), F.first("slug").alias("name"))
    want = {r.slug for r in H.review_queue(seen, F.lit(now)).where("reason = 'stale'").collect()}
    told = Y.stale_by(events, F.lit(now), scratch(spark, "stale")).collect()
    assert {r.slug for r in told} == want and 5 < len(want) < 55 and len(told) == len(want)
    assert all(r.stale_at >= r["last"] + 90 * Y.DAY_MS for r in told)


def test_the_day_of_staleness_is_where_the_decayed_confidence_falls(spark):
    cases = [(b, n) for b in (0.1, 0.31, 0.4, 0.55, 0.62, 0.8, 1.0) for n in (0, 1, 2, 3, 15)]
    for base, n in cases:
        days = Y.stale_after_days(base, n)
        ages = [days - 0.01, days + 0.01] if days else [90.01, 9999.0]
        rows = spark.createDataFrame([(base, n, a) for a in ages], "b double, n int, age double")
        told = [r.s for r in rows.select(H.is_stale(H.adjusted_confidence(F.col("b"), F.col("age"), F.col("n")), F.col("age")).alias("s")).collect()]
        assert told == ([False, True] if days else [False, False]), (base, n, days)


def test_only_names_whose_letters_allow_the_ratio_are_paired_and_the_first_is_matched(spark):
    from collections import Counter

    from thoughtloom.operators import evaluation as E

    rng = random.Random(5)
    names = lambda n, most: ["".join(rng.choices("abcdeé", k=rng.randint(1, most))) for _ in range(n)]
    left, right = [(f"e{i:03}", x) for i, x in enumerate(names(60, 24))], [(f"a{i:03}", y.upper()) for i, y in enumerate(names(60, 24))]
    frames = spark.createDataFrame(left, "e string, x string"), spark.createDataFrame(right, "a string, y string")
    for threshold in (0.85, 0.5):
        fit = {(e, a) for e, x in left for a, y in right if 2 * sum((Counter(x) & Counter(y.lower())).values()) >= threshold * (len(x) + len(y)) - 1e-9}
        got = [(r.e, r.a) for r in H.ratio_candidates(*frames, threshold).collect()]
        assert fit and sorted(got) == sorted(fit)
    want = {}
    for e, x in left:
        for a, y in right:
            if e not in want and SequenceMatcher(None, x, y.lower()).ratio() >= 0.7:
                want[e] = a
    slugs = lambda frame, key, name: frame.selectExpr(f"{key} AS slug", f"{name} AS name")
    assert {r.e: r.a for r in E.match_concepts(slugs(frames[0], "e", "x"), slugs(frames[1], "a", "y"), 0.7).collect()} == want
