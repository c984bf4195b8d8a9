"""Concepts that turn stale by themselves: a stream with state in which a timer stands for the day.

What reinforces a concept (an event with its time, source and confidence) sets the timer to the moment at which
the decayed confidence falls under the limit, if nothing else comes. When the watermark passes it, the concept
is told as stale, once; a later event makes it fresh again. No batch over all concepts is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.hygiene import EFOLD_DAYS, STALE_CONFIDENCE, STALE_DAYS

DAY_MS = 86_400_000


def stale_after_days(base: float, sources: int, efold: float = EFOLD_DAYS) -> float | None:
    """Days without an event after which a concept counts as stale, or None if it never does.

    The confidence, to three places, is base * (0.5 + kept / 2), kept being the larger of exp(-days / efold) and
    what the number of sources holds up; it must fall under STALE_CONFIDENCE, and STALE_DAYS must have passed.
    """
    least = STALE_CONFIDENCE - 0.0005  # what is under it is rounded to less than the limit
    floor = min(1.0, math.log2(1 + max(sources, 0)) / 4)
    if base * (0.5 + floor * 0.5) >= least:
        return None
    kept = 2 * (least / base - 0.5) if base > 0 else 1.0
    return STALE_DAYS if kept >= 1 else max(STALE_DAYS, -efold * math.log(kept))


class _Staleness(StatefulProcessor):
    """Of each key the last time, sum and number of confidences, and the set of sources."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "last bigint, total double, n bigint, sources string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, total, n, sources = self.known.get() if self.known.exists() else (None, 0.0, 0, "")
        held = set(sources.split("\n")) - {""}
        for frame in rows:
            frame = frame[frame["source"].notna()]
            if not len(frame):
                continue
            newest = int(frame["at"].max())
            last = newest if last is None else max(last, newest)
            total, n = total + float(frame["confidence"].sum()), n + len(frame)
            held |= set(frame["source"])
        if last is None:
            return  # a row that only moves the time
        self.known.update((last, total, n, "\n".join(sorted(held))))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        days = stale_after_days(min(round(total / n, 6), 1.0), len(held))
        if days is not None:
            self.handle.registerTimer(last + math.floor(days * DAY_MS) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, total, n, sources = self.known.get()
        yield pd.DataFrame({"slug": [key[0]], "last": [last], "stale_at": [expiredTimerInfo.getExpiryTimeInMs()], "sources": [len(sources.split("\n"))]})

    def close(self) -> None:
        pass


def stale_concepts(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(slug, last, stale_at, sources) told when a concept turns stale; times in milliseconds.

    ``events`` is a stream of (slug, ts, source, confidence); a row without a source moves the time only. The state
    store has to be the RocksDB one (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.withWatermark("ts", delay).select("slug", "ts", F.unix_millis("ts").alias("at"), "source", "confidence")
    return rows.groupBy("slug").transformWithStateInPandas(_Staleness(), "slug string, last bigint, stale_at bigint, sources int", "append", "eventTime")


def stale_by(events: DataFrame, now: Column, folder: str) -> DataFrame:
    """What ``stale_concepts`` has told of a stored log (slug, ts, source, confidence) when the time is ``now``.

    The log and then the time arrive as files under ``folder``, and the query is started for each on one checkpoint.
    """
    spark = events.sparkSession
    schema = "slug string, ts timestamp, source string, confidence double"
    columns = [F.col(c).cast(k) for c, k in (x.split() for x in schema.split(", "))]
    tick = spark.range(1).select(F.lit("").alias("slug"), now.cast("timestamp").alias("ts"), F.lit(None).alias("source"), F.lit(None).alias("confidence")).select(*columns)
    setting, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, rocks)
    try:
        for rows in (events.select(*columns), tick, tick):  # what the first tick makes due is told with the second
            rows.write.mode("append").parquet(f"{folder}/in")
            told = stale_concepts(spark.readStream.schema(schema).parquet(f"{folder}/in"))
            told.writeStream.format("parquet").options(checkpointLocation=f"{folder}/checkpoint", path=f"{folder}/out").trigger(once=True).start().awaitTermination()  # one batch: there would be another one for ever while timers are set
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema("slug string, last bigint, stale_at bigint, sources int").parquet(f"{folder}/out")
