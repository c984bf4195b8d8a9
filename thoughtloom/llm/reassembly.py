"""Conversation turns that arrive out of order, late and repeatedly, put together again by a stream with state.

Arrivals come in numbered batches. For each batch a Structured Streaming query is started anew on the one
checkpoint, with the batch's number in the closure of its state function. A conversation's state is a
serialized min-heap of kept turns that are not released yet, and the set of kept turns, of which the
gapless run that is released is a pair of numbers and the rest what is in the heap. While the top of the
heap is the next turn, it is released. The first arrival of a turn is kept. A conversation without an
arrival is called by its timeout, compares its last batch with the closure's number, and closes after
``quiet`` batches; later arrivals are rejected. ``finish`` closes what is open.

Neither state nor stream holds a text: both have the turn, its role and the batch in which it came; texts are
joined to the events by those. Rows of equal turn are reduced to one before they are written, so
what goes to a conversation's task in a batch are its different turns of that batch; the state
grows with the turns that wait, not with those released. Turns of one conversation are put in order in one
task, a batch at a time; a turn is some 40 bytes there. Batches lie in the shared folder, as do checkpoint
and events; a lost executor costs a part of one batch.

Null turns are dropped; null role and text count as empty. A null conv_id is one conversation. Repeated
rows, and rows of one turn in a batch, are one arrival: that of the smallest payload ``role|text`` by UTF-8
bytes, then of the smallest role. An empty batch counts as a batch. Other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import scratch_path, shared_dir, table

_ARRIVAL = "key string, first bigint, turn bigint, role string, batch int"
_STATE = "first bigint, next bigint, role string, kept bigint, top bigint, breaks bigint, last int, closed boolean, heap binary"
_EVENT = "event string, key string, turn bigint, batch bigint, came bigint, unreleased array<bigint>, n_missing bigint, n_breaks bigint"
#: The key of the row that makes an empty batch a batch; keys of conversations are numbers or empty.
_TICK = "tick"


class _Conversation:
    """What is known of a conversation, and what an arrival or the end of its time makes of it."""

    def __init__(self, key: str, first: int):
        self.key, self.first, self.next, self.role = key, first, first, None
        self.kept, self.top, self.breaks, self.last, self.closed = 0, first - 1, 0, 0, False
        self.heap: list = []  # (turn, batch in which it came, role)
        self.events: list = []

    @classmethod
    def stored(cls, key: str, state: tuple) -> _Conversation:
        out = cls(key, state[0])
        out.next, out.role, out.kept, out.top, out.breaks, out.last, out.closed = state[1:8]
        out.heap = [tuple(x) for x in json.loads(bytes(state[8]))]
        return out

    def to_store(self) -> tuple:
        heap = json.dumps(self.heap, separators=(",", ":")).encode()
        return self.first, self.next, self.role, self.kept, self.top, self.breaks, self.last, self.closed, heap

    def tell(self, event: str, turn: int, batch: int, came: int | None, *rest) -> None:
        self.events.append((event, self.key, turn, batch, came, *(rest or (None, None, None))))

    def arrive(self, turns: dict[int, str], batch: int) -> None:
        """Keeps the turns that are new, and releases what has become gapless."""
        waiting = {turn: role for turn, _, role in self.heap}
        if self.next > self.first:
            waiting[self.next - 1] = self.role
        new = [t for t in sorted(turns) if t >= self.next and t not in waiting]
        for turn in new:
            waiting[turn] = turns[turn]
            heapq.heappush(self.heap, (turn, batch, turns[turn]))
        added = set(new)
        self.breaks += sum(waiting.get(t - 1) == waiting[t] for t in new)
        self.breaks += sum(waiting.get(t + 1) == waiting[t] for t in new if t + 1 not in added)
        self.kept, self.top, self.last = self.kept + len(new), max([self.top, *new]), batch
        while self.heap and self.heap[0][0] == self.next:
            turn, came, self.role = heapq.heappop(self.heap)
            self.tell("release", turn, batch, came)
            self.next += 1

    def close(self, batch: int) -> None:
        left = sorted(turn for turn, _, _ in self.heap)
        self.tell("close", -1, batch, None, left, self.top - self.first + 1 - self.kept, self.breaks)
        self.closed, self.heap, self.role = True, [], None


def _frame(events: list[tuple]) -> pd.DataFrame:
    """Events as a frame of plain objects: nulls stay nulls, and there is no conversion for each conversation."""
    columns = {}
    for name, values in zip(("event", "key", "turn", "batch", "came", "unreleased", "n_missing", "n_breaks"), zip(*events)):
        columns[name] = np.empty(len(values), dtype=object)
        columns[name][:] = values
    return pd.DataFrame(columns, copy=False)


def _step(batch: int, quiet: int, ends: bool):
    """The state function of the query that is started for ``batch``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        turns: dict[int, str] = {}
        first = None
        if not state.hasTimedOut:
            for frame in frames:
                for turn, role, f in zip(frame["turn"], frame["role"], frame["first"]):
                    if key[0] != _TICK:
                        turns[int(turn)], first = role, int(f)
        if not turns and not state.exists:
            return
        talk = _Conversation.stored(key[0], state.get) if state.exists else _Conversation(key[0], first)
        if state.exists and not talk.closed and (talk.last + quiet < batch or not turns and (ends or talk.last + quiet <= batch)):
            talk.close(min(talk.last + quiet, batch))
        if turns and talk.closed:
            for turn in sorted(turns):
                talk.tell("reject", turn, batch, batch)
        elif turns:
            talk.arrive(turns, batch)
            if ends:
                talk.close(batch)
        state.update(talk.to_store())
        if not talk.closed:
            state.setTimeoutDuration(1)  # any later batch, which then looks at its number
        if talk.events:
            yield _frame(talk.events)

    return step


class Reassembly:
    """Batches of arrivals, fed in order, and the events that they cause; all files are under ``folder``.

    ``rows`` has ``conv``, ``turn``, ``role``, ``text`` and the number of a batch in ``batch`` (from 0).
    """

    def __init__(self, rows: DataFrame, batches: int, quiet: int = 2, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", batch: str = "batch", folder: str | None = None):
        self.spark, self.batches, self.quiet = rows.sparkSession, batches, quiet
        shared_dir(self.spark)
        self.folder = folder or scratch_path(self.spark, "reassembly")
        empty = F.lit("")
        read = rows.where(F.col(turn).isNotNull()).select(
            F.coalesce(F.col(conv).cast("string"), empty).alias("key"), F.col(turn).cast("bigint").alias("turn"),
            F.coalesce(F.col(role), empty).alias("role"), F.coalesce(F.col(text), empty).alias("text"), F.col(batch).cast("int").alias("batch"))
        firsts = read.groupBy("key").agg(F.min("turn").alias("first"))
        said = F.struct(F.concat("role", F.lit("|"), "text").alias("payload"), "role")
        arrived = read.groupBy("batch", "key", "turn").agg(F.min(said).alias("said")).join(firsts, "key")
        arrived = arrived.select("key", "first", "turn", "said.role", "said.payload", "batch")
        ticks = self.spark.range(batches + 1).select(F.lit(_TICK).alias("key"), F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("turn"), empty.alias("role"), empty.alias("payload"), F.col("id").cast("int").alias("batch"))
        arrived.unionByName(ticks).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{self.folder}/waiting")

    def _move(self, batch: int) -> None:
        """The batch's files land in the folder that the stream watches."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        source, target = path(f"{self.folder}/waiting/batch={batch}"), path(f"{self.folder}/arrived/batch={batch}")
        fs = source.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(target.getParent())
        if not fs.rename(source, target):
            raise OSError(f"cannot move {source.toString()}")

    def feed(self, batch: int) -> None:
        """Lets a batch arrive, and runs the query until it is through. The one after the last closes what is open."""
        self._move(batch)
        arrivals = self.spark.readStream.schema(_ARRIVAL).parquet(f"{self.folder}/arrived")
        step = _step(batch, self.quiet, batch == self.batches)
        events = arrivals.groupBy("key").applyInPandasWithState(step, _EVENT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
        asked = {"checkpointLocation": f"{self.folder}/checkpoint", "path": f"{self.folder}/events"}
        query = events.writeStream.format("parquet").options(**asked).outputMode("append").trigger(once=True).start()
        query.awaitTermination()

    def run(self) -> DataFrame:
        """Feeds all batches, then the end; returns the events."""
        for batch in range(self.batches + 1):
            self.feed(batch)
        return self.events()

    def events(self) -> DataFrame:
        """(event, conv_id as text, turn, batch, payload, unreleased turns of a close, n_missing, n_breaks)."""
        told = self.spark.read.parquet(f"{self.folder}/events")
        texts = self.spark.read.schema("key string, turn bigint, payload string, batch int").parquet(f"{self.folder}/arrived")
        texts = texts.withColumnRenamed("batch", "came").withColumn("came", F.col("came").cast("bigint"))
        joined = told.where("came is not null").join(texts, ["key", "turn", "came"])
        rows = joined.unionByName(told.where("came is null"), allowMissingColumns=True)
        return rows.select("event", F.expr("nullif(key, '')").alias("conv_id"), "turn", "batch", "payload", "unreleased", "n_missing", "n_breaks")


def dealt(rows: DataFrame, batches: int = 12, again: int = 5) -> DataFrame:
    """``rows`` of a log of conversations with a ``batch`` each; two of seven come a second time, as the user's, ``again`` batches on."""
    h: Column = F.conv(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    once = F.struct((h % batches).alias("batch"), F.col("role").alias("role"))
    twice = F.struct(((h + again) % batches).alias("batch"), F.lit("user").alias("role"))
    came = F.explode(F.when(h % 7 < 2, F.array(once, twice)).otherwise(F.array(once)))
    return rows.where("turn is not null").select("conv_id", "turn", "text", came.alias("came")).select("conv_id", "turn", "text", "came.*")


def op12_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Reassembly(dealt(table(spark, sf_dir, "conversations")), batches=12, quiet=2).run()
    told = F.when(F.col("event") == "close", F.array_join(F.transform("unreleased", lambda t: t.cast("string")), ",")).otherwise(F.col("payload"))
    return events.select("event", F.sha2(told, 256).alias("sha256"), F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "batch", "n_missing", "n_breaks")


OP12_SQL = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  ('0x' || substr(sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn::VARCHAR), 1, 8))::BIGINT AS h FROM conversations WHERE turn IS NOT NULL),
c AS (SELECT conv_id, turn, role, text, h % 12 AS b FROM r UNION ALL SELECT conv_id, turn, 'user', text, (h + 5) % 12 FROM r WHERE h % 7 < 2),
a AS (SELECT conv_id, turn, b, min({'p': role || '|' || text, 'r': role}) AS said FROM c GROUP BY ALL),
came AS (SELECT DISTINCT conv_id, b FROM a),
gaps AS (SELECT conv_id, b, lead(b) OVER (PARTITION BY conv_id ORDER BY b) AS n FROM came),
shut AS (SELECT conv_id, least(min(b) + 2, 12) AS shut FROM gaps WHERE n IS NULL OR n > b + 2 GROUP BY conv_id),
firsts AS (SELECT conv_id, min(turn) AS f FROM r GROUP BY conv_id),
k AS (SELECT a.conv_id, a.turn, min(a.b) AS came, arg_min(a.said, a.b) AS said FROM a JOIN shut s ON a.conv_id IS NOT DISTINCT FROM s.conv_id WHERE a.b <= s.shut GROUP BY ALL),
o AS (SELECT k.*, f.f, row_number() OVER w AS i, max(came) OVER w AS out, lag(turn) OVER w AS before, lag(said.r) OVER w AS spoke
  FROM k JOIN firsts f ON k.conv_id IS NOT DISTINCT FROM f.conv_id WINDOW w AS (PARTITION BY k.conv_id ORDER BY turn)),
t AS (SELECT *, turn - f + 1 = i AS free FROM o),
closing AS (SELECT conv_id, coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (NOT free), '') AS waits, max(turn) - min(f) + 1 - count(*) AS missing,
  count(*) FILTER (before = turn - 1 AND spoke = said.r) AS breaks FROM t GROUP BY conv_id)
SELECT 'release' AS event, sha256(said.p) AS sha256, conv_id, turn, out::BIGINT AS batch, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM t WHERE free
UNION ALL SELECT 'reject', sha256(a.said.p), a.conv_id, a.turn, a.b, NULL, NULL FROM a JOIN shut s ON a.conv_id IS NOT DISTINCT FROM s.conv_id WHERE a.b > s.shut
UNION ALL SELECT 'close', sha256(c.waits), c.conv_id, -1, s.shut, c.missing, c.breaks FROM closing c JOIN shut s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
"""
