"""SimHash near-duplicates by anchor-point covering.

Fingerprints are 64-bit majorities over the hashed word shingles of a text. Two fingerprints are
linked if they differ in at most 3 bits; then they differ in at most 1 bit in one of their halves.
In each half (31 of its 32 bits) the anchors are the words of the perfect [31, 26] Hamming code,
whose covering radius is 1. A fingerprint is at home at its nearest anchor and is replicated to
every anchor within covering radius plus threshold, 1 + 1 = 2: at most 16 anchors a half. So of two
linked fingerprints each meets the other at its own home anchor, where all 64 bits are compared.

Only distinct fingerprints are replicated, so groups of copies of any size cost one fingerprint;
at an anchor the pairs are compared in blocks of bounded memory and only a spanning star of what is
linked leaves the task. Distinct fingerprints that share an anchor have nearly equal 31-bit halves,
which bounds an anchor's load by the variety of the other half, not by the number of documents.

A null or empty text has fingerprint zero and is linked like any other; a text shorter than one
shingle is one shingle. Null ids take no part in the choice of ``component_id`` unless the whole
component has null ids. Repeated rows each get their row. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import checkpointed, table
from .components import connected_components

SEED = 42
#: The most differing bits of two linked fingerprints.
THRESHOLD = 3
#: Pairs that are compared at once.
PAIRS = 1 << 21
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _shingle_hashes(text: bytes, width: int) -> list[int]:
    words = text.translate(_LOWER).split()  # bytes.split() cuts at \x20 and \x09 to \x0D
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return [digest(joined, SEED)] if words else []
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - width].tolist() if width > 1 else (ends - lengths).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())]


def _majority(hashes: list[int], counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from all shingle hashes in order."""
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """(key, fp long) of each row; ``width`` words make a shingle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for _, data, offsets in wh.text_slices(batch.column(text)):
                hashes, counts, whole = [], [], data.tobytes()
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    own = _shingle_hashes(whole[a:b], width)
                    hashes += own
                    counts.append(len(own))
                found.append(_majority(hashes, np.array(counts, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(np.concatenate(found).view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def _syndromes(x: np.ndarray) -> np.ndarray:
    """The Hamming syndrome of 31-bit words: the exclusive or of the places (1 to 31) of their ones."""
    out = np.zeros(x.shape, dtype=np.int64)
    for place in range(1, 32):
        out ^= ((x >> (place - 1)) & 1) * place
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for 31-bit words: each home anchor, and all others within distance 2."""
    rows = np.arange(len(half))
    s = _syndromes(half)
    home = np.where(s > 0, half ^ (np.int64(1) << np.maximum(s - 1, 0)), half)
    out_rows, out_anchor, out_home = [rows], [home], [np.ones(len(half), dtype=bool)]
    for i in range(1, 32):
        j = s ^ i
        which = np.flatnonzero((s > 0) & (i < j))
        out_rows.append(which)
        out_anchor.append(half[which] ^ (np.int64(1) << (i - 1)) ^ (np.int64(1) << (j[which] - 1)))
        out_home.append(np.zeros(len(which), dtype=bool))
    return np.concatenate(out_rows), np.concatenate(out_anchor), np.concatenate(out_home)


def _replicate(batches):
    """(key, fp): the half and anchor, doubled, plus 1 where the fingerprint is only a replica."""
    for batch in batches:
        whole = batch.column("fp").to_numpy(zero_copy_only=False)
        for fp in np.array_split(whole, max(1, len(whole) // 20_000)):
            keys, values = [], []
            for side in (0, 1):
                row, anchor, home = anchors((fp >> (32 * side)) & 0x7FFFFFFF)
                keys.append((((side << 31) | anchor) << 1) | ~home)
                values.append(fp[row])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], names=["key", "fp"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give a and b, and all that hang together with them, the same smallest label."""
    while len(a):
        np.minimum.at(label, label[a], label[b])
        np.minimum.at(label, label[b], label[a])
        while not np.array_equal(label, up := label[label]):
            label[:] = up
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]


def _star_edges(key: np.ndarray, fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is linked at the same anchor; rows are sorted by key."""
    anchor, home = key >> 1, (key & 1) == 0
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(new, len(anchor)))
    homes = np.add.reduceat(home.astype(np.int64), new)
    keep = np.repeat((size > 1) & (homes > 0), size)
    anchor, home, fp = anchor[keep], home[keep], fp[keep]
    if not len(fp):
        return fp, fp
    new = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    size = np.diff(np.append(new, len(anchor)))
    begin, width = np.repeat(new, size), np.repeat(size, size)
    label, own = np.arange(len(fp)), np.flatnonzero(home)
    budget = np.cumsum(width[own])
    at = 0
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(budget, (budget[at - 1] if at else 0) + PAIRS, side="right")))
        part = own[at:to]
        left = np.repeat(part, width[part])
        step = np.cumsum(width[part]) - width[part]
        right = np.arange(len(left)) - np.repeat(step, width[part]) + begin[left]
        near = np.flatnonzero(_popcount(fp[left] ^ fp[right]) <= threshold)
        left, right = left[near], right[near]
        _unite(label, left[left != right], right[left != right])
        at = to
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return fp[moved], fp[label[moved]]


def _links(threshold: int):
    def run(batches):
        rest_key, rest_fp = [], []
        for batch in batches:
            key, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp"))
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1] >> 1 << 1))
            if cut:  # an anchor ends in this batch
                a, b = _star_edges(np.concatenate([*rest_key, key[:cut]]), np.concatenate([*rest_fp, fp[:cut]]), threshold)
                rest_key, rest_fp = [], []
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            elif rest_key and rest_key[-1][-1] >> 1 != key[0] >> 1:
                a, b = _star_edges(np.concatenate(rest_key), np.concatenate(rest_fp), threshold)
                rest_key, rest_fp = [], []
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            rest_key.append(key[cut:])
            rest_fp.append(fp[cut:])
        if rest_key:
            a, b = _star_edges(np.concatenate(rest_key), np.concatenate(rest_fp), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def linked(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) over distinct fingerprints whose components are those of all links."""
    if threshold not in (0, 1, 2, 3):
        raise ValueError("the covering of two halves with radius 2 holds for thresholds up to 3")
    spread = fps.select("fp").mapInArrow(_replicate, "key long, fp long")
    parted = spread.repartition(F.expr("key >> 1")).sortWithinPartitions("key")
    return parted.mapInArrow(_links(threshold), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """(key, fp, component_id) of each row; component_id is the smallest key of its component."""
    marked = checkpointed(fingerprints(docs, text, key, width))
    classes = marked.groupBy("fp").agg(F.min(key).alias("least"))
    roots = connected_components(linked(classes.select("fp"), threshold))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(heads, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(key, "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
