"""A stored inverted index over texts: exact best hits by opening few blocks, updated by segments.

A task inverts the texts that it reads, in runs of about RUN bytes: those of a run that are of similar length
are dealt into blocks of about BLOCK, a posting list is cut along the blocks, and the run is written in the order of its
words. So a build moves nothing between tasks. Each piece of a list knows the number of its texts and the largest share
that its word has in one of them. Summed over a question's words these maxima bound every score within a block. A
question reads the maxima of its words, opens the blocks of largest bound, takes the k-th best score, and then opens the others
whose bound reaches it; no text of the rest can be among the best. Short texts have large shares, so blocks of long ones are
seldom opened. Where in a file a word can stand is told by Parquet's column index, as pages hold few words each.

A text is known by its block and its place there; the block has a row of its own with keys and lengths. An update is a
segment of its own: blocks of the new texts, and the places of the older ones that no longer hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import stored

#: Texts of a block, bytes of the texts that are inverted at once, and blocks that are opened to find the threshold.
BLOCK, RUN, FIRST = 128, 1 << 24, 8
#: Rows that a task passes on at once.
ROWS = 1 << 16
#: Where the segment and the task stand in a block's number.
_SEGMENT, _TASK = 1 << 44, 1 << 22

#: A row with a token is a piece of its list (places and counts in a block), one without is the block itself.
_INVERTED = "token string, block bigint, texts int, most double, places array<int>, counts array<int>, keys array<string>, lengths array<int>"
_POSTINGS = f"{_INVERTED}, segment int"
_STALE = "block bigint, place int, segment int"

#: What a word is made of, in lower case; everything else parts words.
_SIGNS = np.array([b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256)], dtype=np.uint8)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(text, word) of every word in order; ``texts`` are bytes in lower case."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    signs = _SIGNS[data]
    inside = np.zeros(len(signs) + 2, dtype=bool)
    inside[1:-1] = signs != 32
    opens = inside[1:-1] & ~inside[:-2]
    first = offsets[:-1][offsets[:-1] < len(signs)]
    opens[first] = inside[1 + first]  # a word does not go on in the next text
    begins = np.flatnonzero(opens)
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    last = offsets[1:][(offsets[1:] > 0) & (offsets[1:] < len(signs))]
    cut = last[inside[last] & inside[last + 1]]
    ends = np.unique(np.concatenate([ends, cut]))
    lengths = ends - begins
    text = np.searchsorted(offsets, begins, side="right") - 1
    packed = signs[inside[1:-1]]
    bounds = np.append(0, np.cumsum(lengths)).astype(np.int32)
    said = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(bounds), pa.py_buffer(packed))
    return text, said.dictionary_encode()


def _lists(bounds: np.ndarray, values: pa.Array, at: slice) -> pa.Array:
    """Lists of the rows ``at``, which begin at ``bounds``."""
    some = bounds[at.start : at.stop + 1]
    return pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), values.slice(int(some[0]), int(some[-1] - some[0])))


def _inverted(keys: pa.Array, texts: pa.Array, first: int) -> tuple[int, Iterator[pa.RecordBatch]]:
    """How many blocks a run has, and their rows; blocks are numbered from ``first``."""
    text, said = _words(texts)
    lengths = np.bincount(text, minlength=len(texts))
    level = np.floor(np.log2(lengths + 1) * 4).astype(np.int64)
    by_length = np.argsort(level, kind="stable")
    _, begins, many = np.unique(level[by_length], return_index=True, return_counts=True)
    rank = np.arange(len(texts)) - np.repeat(begins, many)
    blocks = -(-many // BLOCK)
    own = np.repeat(np.cumsum(blocks) - blocks, many) + rank % np.repeat(blocks, many)
    order = np.argsort(own, kind="stable")
    block = np.empty(len(texts), dtype=np.int64)
    block[by_length] = own
    seats = np.append(0, np.cumsum(np.bincount(own))).astype(np.int64)
    listed = by_length[order]  # the texts block by block
    seat = np.empty(len(texts), dtype=np.int64)
    seat[listed] = np.arange(len(texts))

    def rows():
        # the blocks themselves
        n = len(seats) - 1
        shown, known = keys.take(pa.array(listed)), pa.array(lengths[listed].astype(np.int32))
        for a in range(0, n, ROWS // BLOCK):
            at = slice(a, min(a + ROWS // BLOCK, n))
            size = at.stop - at.start
            numbers = pa.array(np.arange(at.start, at.stop) + first)
            held = pa.array(np.diff(seats)[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.string()), numbers, held, pa.nulls(size, pa.float64()), pa.nulls(size, pa.list_(pa.int32())), pa.nulls(size, pa.list_(pa.int32())), _lists(seats, shown, at), _lists(seats, known, at)], names=names)
        if not len(text):
            return
        # their postings, in the order of words and seats
        names_, codes = said.dictionary, said.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sorting = pc.sort_indices(names_).to_numpy()
        place = np.empty(len(sorting), dtype=np.int64)
        place[sorting] = np.arange(len(sorting))
        cells = place[codes] * len(texts) + seat[text]
        cells.sort()
        new = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        tf = np.diff(np.append(new, len(cells)))
        word, at_seat = np.divmod(cells[new], len(texts))
        which = listed[at_seat]
        inside = block[which]
        starts = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (inside[1:] != inside[:-1])))
        bounds = np.append(starts, len(word))
        most = np.maximum.reduceat(tf / lengths[which], starts)
        places, counts = pa.array((at_seat - seats[inside]).astype(np.int32)), pa.array(tf.astype(np.int32))
        for a in range(0, len(starts), ROWS):
            at = slice(a, min(a + ROWS, len(starts)))
            size = at.stop - at.start
            token = names_.take(pa.array(sorting[word[starts[at]]]))
            yield pa.RecordBatch.from_arrays([token, pa.array(inside[starts[at]] + first), pa.array(np.diff(bounds)[at].astype(np.int32)), pa.array(most[at]), _lists(bounds, places, at), _lists(bounds, counts, at), pa.nulls(size, pa.list_(pa.string())), pa.nulls(size, pa.list_(pa.int32()))], names=names)

    names = [c.split()[0] for c in _INVERTED.split(", ")]
    return len(seats) - 1, rows()


def _invert(segment: int, run_bytes: int):
    """Rows of blocks and postings from batches of (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = segment * _SEGMENT + TaskContext.get().partitionId() * _TASK
        held, size = [], 0
        for batch in batches:
            at, ends = 0, np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False) + 32)
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + run_bytes - size, side="right")))
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - before
                at = to
                if size >= run_bytes or at < batch.num_rows:
                    n, rows = _inverted(*_joined(held), first)
                    yield from rows
                    first, held, size = first + n, [], 0
        if held:
            yield from _inverted(*_joined(held), first)[1]

    return run


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    one = pa.Table.from_batches(held).combine_chunks()
    return one.column("key").chunk(0), one.column("text").chunk(0).cast(pa.binary())


@dataclass
class KeywordIndex:
    """An index in a folder of any file system that Spark writes."""

    spark: SparkSession
    root: str
    run: int = RUN

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def _stale(self) -> DataFrame:
        """(block, place) of the texts that no longer hold."""
        return self._read("stale", _STALE).select("block", "place")

    def _segments(self) -> list[int]:
        return [r[0] for r in self._read("sizes", "n bigint, segment int").select("segment").orderBy("segment").collect()]  # one row per update

    def build(self, texts: DataFrame) -> None:
        """A new index over (key, text); keys are text and unique."""
        self._append(texts, 0, None)

    def update(self, texts: DataFrame, gone: DataFrame | None = None) -> None:
        """Texts that are new or replace those of their keys, and keys (``key``) that go."""
        segments = self._segments()
        keys = texts.select("key") if gone is None else texts.select("key").unionByName(gone.select("key"))
        held = self._read("postings", _POSTINGS).where("token is null").where(F.col("segment").isin(segments)).select("block", F.posexplode("keys").alias("place", "key"))
        if len(segments) > 1:
            held = held.join(self._stale(), ["block", "place"], "left_anti")
        self._append(texts, max(segments) + 1, stored(held.join(keys, "key", "left_semi").select("block", "place")))

    def _rows(self, texts: DataFrame, segment: int) -> DataFrame:
        low = texts.select("key", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
        return low.mapInArrow(_invert(segment, self.run), _INVERTED)

    def _append(self, texts: DataFrame, segment: int, old: DataFrame | None) -> None:
        self._rows(texts, segment).write.parquet(f"{self.root}/postings/segment={segment}")
        sizes = self._read("postings", _POSTINGS).where(f"token is null and segment = {segment}").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n"))
        if old is not None:
            old.write.parquet(f"{self.root}/stale/segment={segment}")
            sizes = sizes.unionByName(old.agg((-F.count("*")).alias("n"))).agg(F.sum("n").alias("n"))
        sizes.write.parquet(f"{self.root}/sizes/segment={segment}")  # last: a segment without a size was not finished

    def _asked(self, lists: DataFrame, question: str) -> DataFrame:
        """(token, weight) of a question: inverse document frequency times how often it asks for the word."""
        said = re.findall("[a-z0-9]+", question.lower())
        asked = self.spark.createDataFrame([(t, said.count(t)) for t in sorted(set(said))], "token string, times int")
        n = self._read("sizes", "n bigint, segment int").agg(F.sum("n").alias("n"))
        found = lists.select("token", F.col("texts").cast("long").alias("df"))
        if len(self._segments()) > 1:  # less the texts that no longer hold, which are looked for in their blocks alone
            stale = self._stale()
            lost = lists.join(stale.select("block").distinct(), "block", "left_semi").select("token", "block", F.explode("places").alias("place"))
            found = found.unionByName(lost.join(stale, ["block", "place"], "left_semi").select("token", F.lit(-1).cast("long").alias("df")))
        df = found.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        return df.join(F.broadcast(asked), "token").join(F.broadcast(n)).select("token", (idf * F.col("times")).alias("weight"))  # as many rows as the question has words

    def search(self, question: str, k: int = 10, digits: int = 12) -> DataFrame:
        """(key, score): the k texts that fit best, with scores as shares of the best; those of ``keyword_scores``."""
        rows, _ = self._search(question, k, digits)
        return rows

    def _search(self, question: str, k: int, digits: int) -> tuple[DataFrame, DataFrame]:
        """The hits, and the blocks that were opened for them."""
        none = self.spark.createDataFrame([], "key string, score double")
        said = sorted(set(re.findall("[a-z0-9]+", question.lower())))
        every = self._read("postings", _POSTINGS).where(F.col("segment").isin(self._segments()))
        lists = every.where(F.col("token").isin(said))
        weights = [tuple(r) for r in self._asked(lists, question).collect()] if said else []
        if not weights:
            return none, self.spark.createDataFrame([], "block long")
        weight = F.broadcast(self.spark.createDataFrame(weights, "token string, weight double"))
        bounds = lists.select("token", "block", "most").join(weight, "token").groupBy("block").agg(F.sum(F.col("most") * F.col("weight")).alias("bound")).where("bound > 0")
        bounds = stored(bounds)
        best = lambda rows: rows.orderBy(F.desc("raw"), "key").limit(k)

        def opened(blocks: DataFrame) -> DataFrame:
            own = lists.join(blocks.select("block"), "block", "left_semi").join(weight, "token").select("block", "weight", F.inline(F.arrays_zip("places", "counts")).alias("place", "tf"))
            if len(self._segments()) > 1:
                own = own.join(self._stale(), ["block", "place"], "left_anti")
            told = every.where("token is null").join(blocks.select("block"), "block", "left_semi").select("block", F.posexplode(F.arrays_zip("keys", "lengths")).alias("place", "t"))
            share = F.col("tf") / F.col("t.lengths")
            own = own.join(told, ["block", "place"]).groupBy("block", "place", F.col("t.keys").alias("key"))
            return own.agg(F.round(F.sum(share * F.col("weight")), digits).alias("raw")).select("key", "raw")

        first = best(opened(bounds.orderBy(F.desc("bound"), "block").limit(FIRST))).agg(F.min("raw"), F.count("*")).head()
        least = first[0] if first[1] == k else 0.0
        reached = bounds.where(F.col("bound") >= least * (1 - 1e-9) - 10.0**-digits)
        hits = stored(best(opened(reached).where("raw > 0")))
        top = hits.agg(F.max("raw").alias("top"))  # one row
        return hits.join(F.broadcast(top)).select("key", (F.col("raw") / F.col("top")).alias("score")), reached
