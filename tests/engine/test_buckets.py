"""A store in buckets against a plain dictionary that goes through the same changes."""

import datetime as dt
import random

from pyspark.sql import functions as F

from thoughtloom.sources import buckets as B

SCHEMA = "slug string, a string, b string, tags array<string>, at timestamp"


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA)


def read(df):
    return {r.slug: (r.a, r.b, r.tags, r.at) for r in df.collect()}


def day(n):
    return F.lit(dt.datetime(2024, 1, n))


def test_equals_a_dictionary(spark, tmp_path):
    rng = random.Random(3)
    store = B.BucketStore(spark, str(tmp_path / "s"), SCHEMA, buckets=8)
    assert store.rows().count() == 0 and store.changes().count() == 0
    state, states = {}, {0: {}}
    for version in range(1, 6):
        rows = {f"k{rng.randint(0, 30)}": (rng.choice(["x", None]), rng.choice(["x", None]), rng.choice([None, [], ["t", None]]), None) for _ in range(rng.choice([2, 9]))}
        gone = {f"k{rng.randint(0, 30)}" for _ in range(3)} - set(rows)
        state = {k: v for k, v in state.items() if k not in gone} | rows
        if version == 4:
            touched = store.replace(frame(spark, state), day(version))
        else:
            touched = store.apply(frame(spark, rows), spark.createDataFrame([(k,) for k in gone], "slug string"), day(version))
        before = states[version - 1]
        moved = {k for k in state.keys() | before.keys() if state.get(k, 0) != before.get(k, 0)}
        of = {r.slug: r.b for r in spark.createDataFrame([(k,) for k in moved], "slug string").select("slug", F.pmod(F.xxhash64("slug"), F.lit(8)).alias("b")).collect()}
        assert touched == sorted(set(of.values()))
        states[version] = dict(state)
    hashes = {v: {r.slug: r.h for r in store.rows(v).select("slug", B.row_hash(SCHEMA_NAMES).alias("h")).collect()} for v in states}
    for v, expected in states.items():
        assert read(store.rows(v)) == expected
        assert {r.slug: r.hash for r in B.state_at(store.changes(), day(v) if v else F.lit(dt.datetime(2023, 1, 1))).collect()} == hashes[v]
    asked = spark.createDataFrame([(f"k{i}", dt.datetime(2024, 1, d, 5)) for i in range(31) for d in range(1, 6)], "slug string, ts timestamp")
    asked = asked.unionByName(asked.where("slug = 'k3'")).unionByName(asked.limit(1).select(F.lit(None).cast("string").alias("slug"), "ts"))
    for share in (1.0, 7 / 161, 0.001):  # no key, one key and all keys met apart
        got = B.as_of(asked, store.changes(), share=share).collect()
        assert len(got) == 161 and [r.hash for r in got if r.slug is None] == [None]
        assert {(r.slug, r.ts.day): r.hash for r in got if r.slug} == {(f"k{i}", d): hashes[d].get(f"k{i}") for i in range(31) for d in range(1, 6)}
    for one, other in ((1, 5), (2, 3), (4, 4)):
        want = {k: "added" if k not in hashes[one] else "deleted" if k not in hashes[other] else "modified" for k in hashes[one].keys() | hashes[other].keys() if hashes[one].get(k) != hashes[other].get(k)}
        assert {r.slug: r.change for r in B.changed_between(store.changes(), day(one), day(other)).collect()} == want


SCHEMA_NAMES = ["slug", "a", "b", "tags", "at"]


def test_a_microsecond_and_the_place_of_a_null_are_changes(spark, tmp_path):
    store = B.BucketStore(spark, str(tmp_path / "s"), SCHEMA)
    one = dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    store.replace(frame(spark, {"k": ("x", None, None, one), "l": ("x", None, None, one)}), day(1))
    store.replace(frame(spark, {"k": (None, "x", None, one), "l": ("x", None, None, one.replace(microsecond=2))}), day(2))
    assert sorted((r.slug, r.change) for r in store.changes().where("day(ts) = 2").collect()) == [("k", "modified"), ("l", "modified")]


def test_stopped_attempt_is_not_seen_and_is_done_again(spark, tmp_path):
    store = B.BucketStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    old = {f"k{i}": ("x", None, None, None) for i in range(20)}
    store.replace(frame(spark, old), day(1))
    store.replace(frame(spark, {"k1": ("y", None, None, None)}), day(2))
    (tmp_path / "s" / "versions" / "000000002").unlink()  # as if stopped before the version was named
    (tmp_path / "s" / "versions" / ".000000002.crc").unlink(missing_ok=True)
    assert read(store.rows()) == old and store.changes().count() == 20
    assert store.replace(frame(spark, old), day(3)) == []
    assert read(store.rows()) == old and store.changes().count() == 20


def test_everything_goes_and_comes_again(spark, tmp_path):
    store = B.BucketStore(spark, str(tmp_path / "s"), SCHEMA, buckets=4)
    rows = {"a": ("x", None, None, None)}
    store.replace(frame(spark, rows), day(1))
    store.replace(frame(spark, {}), day(2))
    assert read(store.rows()) == {} and read(store.rows(1)) == rows
    store.apply(frame(spark, rows), spark.createDataFrame([("zz",)], "slug string"), day(3))
    assert read(store.rows()) == rows and [r.change for r in store.changes().orderBy("ts").collect()] == ["added", "deleted", "added"]
