"""Tables kept in buckets of a key's hash: a change rewrites only the buckets it touches, and any earlier state can be read.

Rows lie in ``rows/<attempt>/bucket=<n>``. A version is a small file that names, for each bucket, the attempt
that wrote it last, so nothing is replaced: what a stopped attempt left is named by no version, and a
version stays readable as it was. What changed is told apart in ``changes``: one row for each key that was
added, modified or deleted, none for keys that stay, so history grows with the changes and not with the store.

Keys are unique and not null. The driver holds a number for each bucket, never a key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import stored
from .storage import Storage

#: Buckets of a new store. A bucket is rewritten whole, so a large store should have more of them.
BUCKETS = 64
#: A key with a larger share of the questions is met apart.
HOT_SHARE = 0.001
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_hash(columns: list[str]) -> Column:
    """A hash that tells any two rows apart, nulls in other places included."""
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(columns))), _EXACT), 256)


@dataclass
class BucketStore:
    """A table of ``schema`` (DDL) in ``root``, unique by ``key``.

    ``told`` is the column that stands for a row in ``changes``; without it that is a hash of the row.
    """

    spark: SparkSession
    root: str
    schema: str
    key: str = "slug"
    buckets: int = BUCKETS
    told: str | None = None

    def __post_init__(self):
        self._files = Storage(self.spark, self.root)
        self._fields = StructType.fromDDL(self.schema)

    def version(self) -> int:
        """The last version; 0 before the first."""
        return max((int(n) for n in self._files.names("versions")), default=0)

    def _manifest(self, version: int) -> dict:
        """{"buckets": how many, "at": {bucket: attempt}} of the last version up to ``version``."""
        known = [int(n) for n in self._files.names("versions") if int(n) <= version]
        return json.loads(self._files.read_text(f"versions/{max(known):09d}")) if known else {"buckets": self.buckets, "at": {}}

    def rows(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its buckets; other buckets' files are not opened."""
        at = self._manifest(self.version() if version is None else version)["at"]
        paths = [f"{self.root}/rows/{attempt}/bucket={b}" for b, attempt in at.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], self._fields)
        return self.spark.read.schema(self._fields).parquet(*paths)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(n)).cast("int")

    def apply(self, rows: DataFrame, gone: DataFrame, ts: Column, version: int | None = None) -> list[int]:
        """The next version: ``rows`` added or in the place of their keys' rows, keys of ``gone`` removed.

        Returns the buckets that were rewritten, which alone are read. A key in both stays with its row.
        ``version`` names the version (the next one); states after the one before it are then left out.
        """
        version = version or self.version() + 1
        before = self._manifest(version - 1)
        names, key = self._fields.names, self.key
        new = stored(rows.select(*names))
        keys = stored(new.select(key).unionByName(gone.select(key)).distinct())
        asked = [r["b"] for r in keys.select(self._bucket(before["buckets"]).alias("b")).distinct().collect()]
        old = self.rows(version - 1, asked)
        was = old.join(keys, key, "left_semi").select(key, row_hash(names).alias("was"))
        now = new.select(key, row_hash(names).alias("now"), (F.col(self.told) if self.told else row_hash(names)).alias("hash"))
        change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
        changed = stored(was.join(now, key, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(key, change.alias("change"), "hash", self._bucket(before["buckets"]).alias("bucket")))
        touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())
        self._write(before, version, touched, old, new, keys, changed, ts)
        return touched

    def replace(self, rows: DataFrame, ts: Column, version: int | None = None) -> list[int]:
        """The next version holds ``rows`` and no others; buckets in which nothing differs stay as they are.

        ``rows`` is read twice: once for hashes, once for what differs.
        """
        version, names = version or self.version() + 1, self._fields.names
        new = rows.select(*names)
        was, now = (d.select(self.key, row_hash(names).alias(n)) for d, n in ((self.rows(version - 1), "was"), (new, "now")))
        differ = stored(was.join(now, self.key, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(self.key, "now"))
        return self.apply(new.join(differ.where("now is not null").select(self.key), self.key, "left_semi"), differ.where("now is null").select(self.key), ts, version)

    def _write(self, before: dict, version: int, touched: list[int], old: DataFrame, new: DataFrame, keys: DataFrame, changed: DataFrame, ts: Column) -> None:
        attempt, bucket = f"{version:09d}-{uuid.uuid4().hex}", self._bucket(before["buckets"])
        after = old.join(keys, self.key, "left_anti").unionByName(new).withColumn("bucket", bucket)
        after = after.where(F.col("bucket").isin(touched)) if touched else after.limit(0)
        after.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/rows/{attempt}")
        changed.select(self.key, "change", "hash", ts.alias("ts")).write.parquet(f"{self.root}/changes/{attempt}")
        written = {n.removeprefix("bucket=") for n in self._files.names(f"rows/{attempt}") if n.startswith("bucket=")}
        at = {b: a for b, a in before["at"].items() if int(b) not in touched} | {b: attempt for b in written}
        told = [*before.get("changes", []), attempt]
        self._files.write_text(f"versions/{version:09d}", json.dumps({"buckets": before["buckets"], "at": at, "changes": told}))

    def changes(self, version: int | None = None) -> DataFrame:
        """(key, change, hash, ts): all that was added, modified or deleted up to a version; hash is null for deleted."""
        told = self._manifest(self.version() if version is None else version).get("changes", [])
        kind = StructType([self._fields[self.key], *StructType.fromDDL("change string, hash string, ts timestamp").fields])
        paths = [f"{self.root}/changes/{attempt}" for attempt in told]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)


def spans(changes: DataFrame, key: str = "slug") -> DataFrame:
    """(key, hash, since, until): when each state held; ``until`` is null for the one that still does."""
    until = F.lead("ts").over(Window.partitionBy(key).orderBy("ts"))
    return changes.select(key, "hash", F.col("ts").alias("since"), until.alias("until")).where("hash is not null")


def state_at(changes: DataFrame, ts: Column, key: str = "slug") -> DataFrame:
    """(key, hash) of all that was there at a time, from the changes up to then."""
    last = F.max_by("hash", "ts")
    return changes.where(F.col("ts") <= ts).groupBy(key).agg(last.alias("hash")).where("hash is not null")


def as_of(asked: DataFrame, changes: DataFrame, key: str = "slug", ts: str = "ts", share: float = HOT_SHARE) -> DataFrame:
    """``asked`` with the ``hash`` that its key had at its time; null where it was not there then.

    The spans of a key do not overlap, so each question meets at most one. Keys with more than ``share``
    of all questions, at most 1 / ``share`` of them, would fill a task each: their spans, one for each
    version at most, go to all tasks instead, and so their questions (and those of null) stay where they are.
    """
    held = spans(changes, key).select(F.col(key).alias("_key"), "hash", "since", "until")
    meets = (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("since")) & (F.col("until").isNull() | (F.col(ts) < F.col("until")))
    least = asked.count() * share
    hot = [r[0] for r in asked.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > least).select(key).collect()]
    apart = F.col(key).isNull() | F.col(key).isin(hot)
    few = spans(changes.where(F.col(key).isin(hot)), key).select(F.col(key).alias("_key"), "hash", "since", "until")
    out = asked.where(~apart).join(held, meets, "left").unionByName(asked.where(apart).join(F.broadcast(few), meets, "left"))
    return out.drop("_key", "since", "until")


def times_compared(runs: DataFrame, since: str | None = None) -> tuple | None:
    """(earlier, latest) of the times of (ts) rows: the last up to ``since``, or the one before; None for fewer than two.

    Where nothing is as old as ``since``, the earlier time lies before everything.
    """
    times = runs.select("ts").distinct()
    latest = times.agg(F.max("ts")).head()[0]
    if latest is None:
        return None
    earlier = times.where(F.col("ts") < F.lit(latest) if since is None else F.col("ts") <= F.lit(since).cast("timestamp")).agg(F.max("ts")).head()[0]
    if earlier is None and times.count() < 2:
        return None
    return earlier or datetime(1900, 1, 1), latest


def changed_between(changes: DataFrame, since: Column, until: Column, key: str = "slug") -> DataFrame:
    """(key, change): how the state at ``until`` differs from that at ``since``; only keys changed in between are looked at."""
    moved = changes.where((F.col("ts") > since) & (F.col("ts") <= until)).select(key).distinct()
    known = changes.join(moved, key, "left_semi")
    was, now = (state_at(known, at, key).withColumnRenamed("hash", name) for at, name in ((since, "was"), (until, "now")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").otherwise("modified")
    return was.join(now, key, "full").where(~F.col("was").eqNullSafe(F.col("now"))).select(key, change.alias("change"))
