"""Conflict-constrained best-fit packing of texts into sequences of a fixed length.

Texts are dealt by a hash of their id, text and length into shards of about ``shard_rows`` pieces,
so a source or cluster of any size is spread evenly, and each shard is packed in one task from a few
numbers per text; texts themselves are not moved. Within a shard pieces go from the longest to the
shortest. Bins are kept in the order of what is left in them, each with a bitmap of its sources and
one of its duplicate clusters. A piece goes to the bin with the least sufficient room: the search
starts at that room and goes on to the next bin until neither bitmap conflicts; it scans blocks of
bins at once, over all bins that could hold the piece. If none fits, a bin is opened.

A text longer than a sequence is cut into pieces of full length and a rest, so nothing is lost;
pieces of the same text conflict through their source, too. Lengths are words unless a column of
lengths (say, tokens) is named; null and empty texts have length 0 and take a place of no room, and
a null or negative length is 0. Null sources conflict with nothing. Ties between pieces go by id
(nulls last), then piece; between bins the one unchanged for longest. Repeated rows are each packed, in different bins where
they share a source or cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import checkpointed, table

#: Length of a sequence, and pieces of a shard.
CAPACITY, SHARD_ROWS = 2048, 8192
_SCAN = 256


def _measure(batches):
    """Words of each text, and a hash of them: equal for texts that differ in spaces or case only."""
    for batch in batches:
        lengths, clusters = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for _, data, offsets in wh.text_slices(batch.column("_pk_text")):
            words = wh.Words(data, offsets, wh.WHITE)
            place = (np.arange(len(words)) - words.first[:-1][words.text]).astype(np.uint64)
            whole = np.zeros(len(words.counts), dtype=np.uint64)
            full = words.counts > 0
            if full.any():
                whole[full] = np.add.reduceat(wh.mix(words.hashes() + place * np.uint64(0x9E3779B97F4A7C15)), words.first[:-1][full])
            lengths.append(words.counts)
            clusters.append(whole.view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "source", "given")), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(clusters))], names=["id", "source", "given", "words", "cluster"])


def pack_pieces(lengths: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, taken in the given order; codes below 0 conflict with nothing."""
    n = len(lengths)
    marks = []
    for codes in (sources, clusters):
        marks.append(np.zeros((n, max(1, int(codes.max(initial=-1)) // 64 + 1)), dtype=np.uint64))
    room, number, used = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), 0
    opened, out = 0, np.zeros(n, dtype=np.int64)
    for i in range(n):
        size = lengths[i]
        own = [(m, c // 64, np.uint64(1) << np.uint64(c % 64)) for m, c in zip(marks, (int(sources[i]), int(clusters[i]))) if c >= 0]
        at, found = int(np.searchsorted(room[:used], size)), -1
        while at < used and found < 0:
            bins = number[at : min(at + _SCAN, used)]
            clash = np.zeros(len(bins), dtype=bool)
            for m, word, bit in own:
                clash |= (m[bins, word] & bit) != 0
            free = np.flatnonzero(~clash)
            if len(free):
                found = at + int(free[0])
            else:
                at += len(bins)
        if found < 0:
            bin_, left, found = opened, capacity - size, used
            opened, used = opened + 1, used + 1
        else:
            bin_, left = number[found], room[found] - size
        to = int(np.searchsorted(room[:found], left, side="right"))
        room[to + 1 : found + 1], number[to + 1 : found + 1] = room[to:found].copy(), number[to:found].copy()
        room[to], number[to] = left, bin_
        for m, word, bit in own:
            m[bin_, word] |= bit
        out[i] = bin_
    return out


def _codes(values: list, alone: bool) -> np.ndarray:
    """Numbers from 0 for equal values; -1 for null and, unless ``alone``, for those seen once."""
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    number: dict = {}
    return np.array([-1 if v is None or (count[v] == 1 and not alone) else number.setdefault(v, len(number)) for v in values], dtype=np.int64)


def _pack_shard(capacity: int):
    def run(rows: pa.Table) -> pa.Table:
        size = rows.column("n").to_numpy()
        pieces = np.maximum(1, -(-size // capacity))
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(capacity, size[row] - piece * capacity)
        missing = rows.column("id").is_null().to_numpy()
        ids = rows.column("id").fill_null(0).to_numpy()
        order = np.lexsort((piece, ids[row], missing[row], -length))
        row, piece, length = row[order], piece[order], length[order]
        sources, clusters = rows.column("source").to_pylist(), rows.column("cluster").to_pylist()
        sources, clusters = [sources[r] for r in row], [clusters[r] for r in row]
        bins = pack_pieces(length, _codes(sources, True), _codes(clusters, False), capacity)
        by_bin = np.lexsort((np.arange(len(bins)), bins))
        slot = np.empty(len(bins), dtype=np.int64)
        first = np.searchsorted(bins[by_bin], bins[by_bin])
        slot[by_bin] = np.arange(len(bins)) - first
        shard = rows.column("shard").to_numpy()[0] if len(size) else 0
        columns = [rows.column("id").take(pa.array(row)), piece, piece * capacity, length, (int(shard) << 32) | bins, slot]
        return pa.table([columns[0], *(pa.array(np.asarray(c, dtype=np.int64)) for c in columns[1:])], names=["id", "piece", "start", "n_words", "bin_id", "slot"])

    return run


def best_fit(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None, length: str | None = None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(key, piece, start, n_words, bin_id, slot): where each piece of each text goes.

    ``cluster`` names a column of duplicate clusters; by default equal texts, apart from spaces
    and the case of A-Z, are a cluster. ``length`` names a column of lengths.
    """
    if capacity < 1:
        raise ValueError("a sequence holds at least one word")
    given = F.lit(None).cast("long") if length is None else F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), given.alias("given"), F.col(text).alias("_pk_text"), *([F.col(cluster).cast("string").alias("own")] if cluster else []))
    if cluster:
        measured = rows.select("id", "source", F.coalesce("given", F.size(F.filter(F.split("_pk_text", r"[ \t-\r]+"), lambda w: w != "")).cast("long"), F.lit(0)).alias("n"), F.col("own").alias("cluster"))
    else:
        measured = rows.mapInArrow(_measure, "id long, source string, given long, words long, cluster long").select("id", "source", F.coalesce("given", "words").alias("n"), F.when(F.col("words") > 0, F.col("cluster").cast("string")).alias("cluster"))
    measured = checkpointed(measured)
    total = measured.agg(F.sum(F.ceil(F.greatest(F.col("n"), F.lit(1)) / capacity))).head()[0] or 0
    shards = max(1, -(-int(total) // shard_rows))
    dealt = measured.withColumn("shard", F.pmod(F.xxhash64("id", "cluster", "n"), F.lit(shards)).cast("long"))
    packed = dealt.groupBy("shard").applyInArrow(_pack_shard(capacity), "id long, piece long, start long, n_words long, bin_id long, slot long")
    return packed.withColumnRenamed("id", key)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
