"""Near-duplicates at a given similarity of word shingles: candidates lose no pair, pairs are verified.

Two texts of similarity t differ in at most d = (1 - t) / (1 + t) * (|a| + |b|) shingles, so candidates
come from signatures that such a pair must share:

- Sets under ``LIMIT`` shingles, and those that may be similar to one: each of the first shingles, the
  rare ones first, of which two similar sets must share one (prefix filter; exact in any common order).
  How often shingles occur is counted over all such texts, in ``COUNTED`` buckets.
- Sets of ``LIMIT`` shingles or more: the shingles are dealt into m parts by hash, and the content of
  each part is a signature. m is chosen for the size class so that of a pair at the threshold MEET
  parts are expected to be untouched; that none is has a probability under exp(-MEET). A class
  holds the sizes up to twice its least; a set that may be similar to one of the next class has
  signatures there too.

Where texts meet under a signature, every two are compared by sketches before anything is tied: two bits of
each of SKETCHED minima over the shingles. A pair at the threshold differs in more places than are let pass with
a probability under 1e-10, another pair of texts hardly ever passes, so that texts which merely share a
shingle do not hang together. Of the pairs that pass, ties that keep them together go on. A signature of more than
``COMPARED`` texts leaves a star of ties without comparison, and where a task sees more than CROWD texts of
one, it ties them under keys of their own, so that a hot signature is spread. Ties come by two ways. Texts whose SimHash fingerprints (of the same shingles) differ in at most THRESHOLD
bits meet at the anchors of ``simhash``, and by these alone: a tie by signatures whose ends are that near is dropped.
Pairs at a similarity of 0.8 mostly differ in more bits, some ten of 64, and are tied by the signatures. Texts that hang together
by ties are candidates of each other. They are verified in units of at most ``UNIT_CHARS`` characters, each
in one task: a search walks from text to text over all pairs that share a prefix shingle, and each pair
is decided on its shingle sets. Candidates that are too many for a unit are split into size classes and
by hash, and every two blocks that can hold a similar pair are a unit; so no pair is left out and no task
holds more than a unit. The links found in all units are joined.

Exact copies are one node, known by two hashes of 64 bits each; where one hash stands for different
texts, those take part as copies only. Texts of fewer words than a shingle are one shingle; texts
without a word are similar to each other only. Null texts count as empty. Rows repeated in key and text
are one text; equal texts under different keys are copies. Null keys are never the smallest of a group.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import checkpointed, fresh, sieve, sifted
from .components import connected_components
from .simhash import THRESHOLD, fingerprints, linked

#: Sets of so many shingles or more are met by parts, smaller ones by prefixes.
LIMIT = 100
#: Untouched parts that are expected of a pair at the threshold.
MEET = 21
#: Buckets in which shingles of short texts are counted.
COUNTED = 1 << 20
#: Characters of the texts that are verified in one task.
UNIT_CHARS = 1 << 24
#: Signatures that a task collects before it passes them on, and texts of one signature that stay together.
FLUSH, CROWD = 1 << 20, 1024
#: Minima of a sketch, and texts of a signature of which every two are compared.
SKETCHED, COMPARED = 64, 1 << 14
#: Bits of a shingle's hash.
BITS = 44
_GOLD = 0x9E3779B97F4A7C15
_SIGN, _SINGLE, _TIE = (np.uint64(x) for x in (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0xA0761D6478BD642F))
_MASK = np.uint64((1 << BITS) - 1)


def _shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the distinct shingle hashes of each text, in ascending order."""
    if len(offsets) - 1 > 1 << (64 - BITS):  # a text's number must fit beside a hash
        middle = len(offsets) // 2
        cut = int(offsets[middle])
        parts = _shingle_sets(data[:cut], offsets[: middle + 1], width), _shingle_sets(data[cut:], offsets[middle:] - cut, width)
        return np.concatenate([parts[0][0], parts[1][0]]), np.concatenate([parts[0][1], parts[1][1]])
    words = wh.Words(data, offsets, wh.WHITE)
    counts = np.asarray(words.counts)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    own, text = words.hashes(), words.text
    weights = [np.uint64((2 * k + 3) * _GOLD % 2**64 | 1) for k in range(width)]
    rolled = own * weights[0]
    for k in range(1, min(width, len(own))):
        rolled[: len(own) - k] += own[k:] * weights[k]
    first = np.cumsum(counts) - counts
    for t in (short := np.flatnonzero((counts > 0) & (counts < width))).tolist():
        rolled[first[t]] = sum(int(x) * int(w) for x, w in zip(own[first[t] : first[t] + counts[t]], weights)) % 2**64
    many = np.maximum(counts - width + 1, 0)
    many[short] = 1
    begins = np.flatnonzero(np.arange(len(own)) - first[text] < many[text])
    cells = (text[begins].astype(np.uint64) << np.uint64(BITS)) | (wh.mix(rolled[begins]) >> np.uint64(64 - BITS))
    cells.sort()
    cells = cells[np.append(True, cells[1:] != cells[:-1])]
    return cells & _MASK, np.bincount((cells >> np.uint64(BITS)).astype(np.int64), minlength=len(counts))


def _prefix(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Of so many first shingles in any common order two similar sets share one."""
    return np.minimum(sizes, np.floor((1 - similarity) * sizes + 1e-6).astype(np.int64) + 1)


@lru_cache(maxsize=256)
def _parts(least: int, similarity: float) -> int:
    """The parts for sets of ``least`` to twice as many shingles."""
    differ, m = 4 * least * (1 - similarity) / (1 + similarity), MEET
    while m * math.exp(-differ / m) < MEET:
        m += 1
    return m


def _counted(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(BITS - 20)).astype(np.int64)


def _signatures(hashes: np.ndarray, counts: np.ndarray, similarity: float, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of all signatures; a text without a shingle has one."""
    text = np.repeat(np.arange(len(counts)), counts)
    bare = np.flatnonzero(counts == 0)
    texts, keys = [bare], [np.zeros(len(bare), dtype=np.uint64)]
    short = np.flatnonzero((counts * similarity < LIMIT)[text])
    h, own = hashes[short], text[short]
    order = np.lexsort((h, often[_counted(h)], own))  # texts stay in place
    h = h[order]
    size = np.where(counts * similarity < LIMIT, counts, 0)
    place = np.arange(len(h)) - (np.cumsum(size) - size)[own]
    early = place < _prefix(counts, similarity)[own]
    texts.append(own[early])
    keys.append(wh.mix(h[early] ^ _SINGLE))
    large = counts >= LIMIT
    level = np.floor(np.log2(np.maximum(counts, LIMIT) / LIMIT)).astype(np.int64)
    for further in (0, 1):
        least = LIMIT << (level + further)
        part = large & (counts >= similarity * least)
        if not part.any():
            continue
        m = np.zeros(len(counts), dtype=np.uint64)
        for x in np.unique(least[part]).tolist():
            m[least == x] = _parts(int(x), similarity)
        which = np.flatnonzero(part[text])
        h, own = hashes[which], text[which]
        dealt = ((h >> np.uint64(BITS - 32)) * m[own]) >> np.uint64(32)  # in order, since hashes are
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (dealt[1:] != dealt[:-1])))
        total = np.add.reduceat(wh.mix(h ^ _SIGN), new)
        texts.append(own[new])
        keys.append(wh.mix(total + wh.mix(dealt[new] + least[own[new]].astype(np.uint64) * np.uint64(_GOLD))))
    return np.concatenate(texts), np.concatenate(keys)


def _frequencies(width: int, similarity: float):
    """(bucket, n): how often shingles of each bucket occur in texts that are met by prefixes."""

    def run(batches):
        total = np.zeros(COUNTED, dtype=np.int64)
        for batch in batches:
            column = batch.column("text")
            few = [np.zeros(0, dtype=np.int64)]
            for at, data, offsets in wh.text_slices(column):
                few.append(at + np.flatnonzero((wh.Words(data, offsets, wh.WHITE).counts - width) * similarity < LIMIT))
            for _, data, offsets in wh.text_slices(column.take(pa.array(np.concatenate(few)))):
                total += np.bincount(_counted(_shingle_sets(data, offsets, width)[0]), minlength=COUNTED)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return run


#: A factor for the order of each minimum.
_FACTORS = wh.mix(np.arange(1, SKETCHED + 1, dtype=np.uint64) * np.uint64(_GOLD)) | np.uint64(1)


def _sketches(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each set: a bit of each minimum in the one, a second bit in the other; zeros for an empty set."""
    low, high = np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts > 0)
    begins = (np.cumsum(counts) - counts)[full]
    for k in range(SKETCHED if len(full) else 0):
        least = wh.mix(np.minimum.reduceat(hashes * _FACTORS[k], begins))
        low[full] |= (least & np.uint64(1)) << np.uint64(k)
        high[full] |= ((least >> np.uint64(1)) & np.uint64(1)) << np.uint64(k)
    return low, high


def _allowed(similarity: float) -> int:
    """In how many minima the sketches of two similar sets may differ: eight standard deviations over the mean."""
    p = 0.75 * (1 - similarity)
    return math.floor(SKETCHED * p + 8 * math.sqrt(SKETCHED * p * (1 - p)))


def _gathered(keys: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The signatures once each; of a crowd under one key one node stays, the others are tied to it, by equal sketches."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    once = np.append(True, (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1]))
    keys, nodes, low, high = keys[once], nodes[once], low[order][once], high[order][once]
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    many = np.diff(np.append(new, len(keys)))
    head = np.repeat(nodes[new], many)
    tied = (np.repeat(many, many) > CROWD) & (nodes != head)
    own = wh.mix(wh.mix(keys[tied] ^ _TIE) + nodes[tied].view(np.uint64))
    none = np.zeros(2 * len(own), dtype=np.uint64)
    return np.concatenate([keys[~tied], own, own]), np.concatenate([nodes[~tied], head[tied], nodes[tied]]), np.append(low[~tied], none), np.append(high[~tied], none)


def _spread(width: int, similarity: float, often):
    def run(batches):
        rows, n = [], 0
        for batch in batches:
            own = batch.column("node").to_numpy(zero_copy_only=False)
            for at, data, offsets in wh.text_slices(batch.column("text")):
                sets = _shingle_sets(data, offsets, width)
                text, key = _signatures(*sets, similarity, often.value)
                rows.append((key, own[at + text], *(x[text] for x in _sketches(*sets))))
                n += len(key)
                if n >= FLUSH:
                    yield out(rows)
                    rows, n = [], 0
        if n:
            yield out(rows)

    def out(rows):
        key, node, low, high = _gathered(*map(np.concatenate, zip(*rows)))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["key", "node", "low", "high"])

    return run


def _tied(key: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray, allowed: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): ties that keep together the nodes of each key whose sketches are close; rows are sorted by key and node."""
    once = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
    key, node, low, high = key[once], node[once], low[once].view(np.uint64), high[once].view(np.uint64)  # of signed numbers absolute values would be counted
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    many = np.diff(np.append(new, len(key)))
    size = np.repeat(many, many)
    pairs = [(np.zeros(0, dtype=np.int64),) * 2]
    few = np.flatnonzero(size <= 16)
    for lag in range(1, 16):
        i = few[few + lag < len(key)]
        i = i[key[i] == key[i + lag]]
        if not len(i):
            break
        i = i[np.bitwise_count((low[i] ^ low[i + lag]) | (high[i] ^ high[i + lag])) <= allowed]
        pairs.append((node[i], node[i + lag]))
    for begin, n in zip(new[many > 16].tolist(), many[many > 16].tolist()):
        left = np.arange(begin, begin + n)
        while len(left) > 1:
            first, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = np.bitwise_count((low[left] ^ low[i]) | (high[left] ^ high[i])) <= allowed
                found, left = left[near], left[~near]
                queue += found.tolist()
                pairs.append((np.full(len(found), node[first]), node[found]))
    a, b = map(np.concatenate, zip(*pairs))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[once], b[once]


def _stars(similarity: float):
    """(a, b): ties of the nodes that meet under a key; rows are sorted by key and node, and a key may go on in the next batch."""
    allowed = _allowed(similarity)

    def run(batches):
        held, crowd = None, None  # the rows of a key that may go on; the key and first node of one with too many
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "low", "high")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            out = [_tied(*(x[:last] for x in rows), allowed)]
            if crowd is not None:  # its rows come first
                k = int(np.searchsorted(rows[0], crowd[0], side="right"))
                out = [(np.full(k, crowd[1]), rows[1][:k]), _tied(*(x[k : max(k, last)] for x in rows), allowed)]
                crowd = crowd if k == len(rows[0]) else None
                last = max(k, last)
            held = [x[last:] for x in rows]
            if len(held[0]) > COMPARED:
                crowd = (held[0][0], held[1][0])
                out.append((np.full(len(held[1]), crowd[1]), held[1]))
                held = [x[:0] for x in held]
            a, b = map(np.concatenate, zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])
        if held is not None and len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _tied(*held, allowed)], names=["a", "b"])

    return run


def _groups(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The number of the first set of its group, for each set: components of all similar pairs."""
    n = len(counts)
    group = np.full(n, -1)
    bare = np.flatnonzero(counts == 0)
    group[bare] = bare[:1].repeat(len(bare))
    _, item, often = np.unique(hashes, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), dtype=np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner = np.repeat(np.arange(n), counts)
    item = rank[item]
    item = item[np.lexsort((item, owner))]
    first, size = np.cumsum(counts) - counts, _prefix(counts, similarity)
    early = np.flatnonzero(np.arange(len(item)) - first[owner] < size[owner])
    order = early[np.argsort(item[early], kind="stable")]
    listed, bounds = owner[order], np.searchsorted(item[order], np.arange(len(often) + 1))
    mark = np.zeros(len(often), dtype=bool)
    for start in range(n):
        if group[start] >= 0:
            continue
        group[start], queue = start, [start]
        while queue:
            a = queue.pop()
            own = item[first[a] : first[a] + counts[a]]
            near = np.unique(np.concatenate([listed[bounds[i] : bounds[i + 1]] for i in own[: size[a]]]))
            near = near[group[near] < 0]
            near = near[(counts[near] >= similarity * counts[a] - 1e-6) & (counts[a] >= similarity * counts[near] - 1e-6)]
            if not len(near):
                continue
            mark[own] = True
            for some in np.array_split(near, 1 + int(counts[near].sum() >> 22)):
                many = counts[some]
                ends = np.cumsum(many)
                inside = mark[item[np.arange(ends[-1]) + np.repeat(first[some] - ends + many, many)]]
                common = np.add.reduceat(inside, ends - many, dtype=np.int64)
                found = some[common >= similarity * (counts[a] + many - common)]
                group[found] = start
                queue += found.tolist()
            mark[own] = False
    return group


def _verify(width: int, similarity: float):
    """(node, root) of the linked nodes of a unit other than the first of their group; rows are sorted by unit and node."""

    def run(batches):
        held, now = [], None  # (node, set) of the unit that is being read

        def done():
            nodes, sets = np.array([x[0] for x in held], dtype=np.int64), [x[1] for x in held]
            group = _groups(np.concatenate(sets), np.array([len(s) for s in sets], dtype=np.int64), similarity)
            linked = np.flatnonzero(group != np.arange(len(group)))
            return nodes[linked], nodes[group[linked]]

        for batch in batches:
            unit, node = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("unit", "node"))
            out = [(np.zeros(0, dtype=np.int64),) * 2]
            for at, data, offsets in wh.text_slices(batch.column("text")):
                hashes, counts = _shingle_sets(data, offsets, width)
                ends = np.cumsum(counts).tolist()
                for k, (a, b) in enumerate(zip([0, *ends], ends), at):
                    if held and unit[k] != now:
                        out.append(done())
                        held.clear()
                    now = unit[k]
                    if not held or held[-1][0] != node[k]:
                        held.append((node[k], hashes[a:b].copy()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["node", "root"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done()], names=["node", "root"])

    return run


def _sizes(width: int):
    def run(batches):
        for batch in batches:
            found = [_shingle_sets(data, offsets, width)[1] for _, data, offsets in wh.text_slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found]))], names=["node", "size"])

    return run


def _blocks(crowded: DataFrame, sizes: DataFrame, similarity: float) -> DataFrame:
    """(unit, node): the units of candidates too many for one; every two that can be similar share a unit.

    A class holds sizes that differ by less than a factor 1 / similarity, so only equal and
    neighbouring classes can hold a pair.
    """
    step = F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / math.log(1.0001 / similarity)).cast("int")
    rows = crowded.join(sizes.dropDuplicates(["node"]), "node").select("loose", "node", "chars", step.alias("c"))
    counts = checkpointed(rows.groupBy("loose", "c").agg(F.ceil(F.sum("chars") / F.lit(UNIT_CHARS / 2)).cast("int").alias("n")))

    def near(shift: int, name: str) -> DataFrame:
        return counts.select("loose", (F.col("c") + shift).alias("c"), F.col("n").alias(name))

    rows = rows.join(counts, ["loose", "c"]).join(near(1, "before"), ["loose", "c"], "left").join(near(-1, "after"), ["loose", "c"], "left")
    salt = F.pmod(F.xxhash64(F.lit("salt"), "node"), "n").cast("int")
    unit = lambda c1, s1, c2, s2: F.xxhash64("loose", c1, s1, c2, s2)
    to = lambda n: F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda i: i < F.coalesce(n, F.lit(0)))
    c = F.col("c")
    own = F.transform(to(F.col("n")), lambda s: unit(c, F.least(s, salt), c, F.greatest(s, salt)))
    later = F.transform(to(F.col("after")), lambda s: unit(c, salt, c + 1, s))
    earlier = F.transform(to(F.col("before")), lambda s: unit(c - 1, s, c, salt))
    return rows.select(F.explode(F.concat(own, later, earlier)).alias("unit"), "node")


def _links(texts: DataFrame, loose: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root) of each node that is linked to another, root being the first of its group.

    ``loose`` has loose, node and chars of each candidate, ``texts`` the node and text of each.
    """
    totals = loose.groupBy("loose").agg(F.sum("chars").alias("total"))
    large = checkpointed(totals.where(F.col("total") > UNIT_CHARS).select("loose"))
    verify = lambda units: units.repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(_verify(width, similarity), "node long, root long")
    if not large.head(1):
        return verify(texts.join(loose.select(F.col("loose").alias("unit"), "node"), "node"))
    crowded = checkpointed(loose.join(large, "loose"))
    whole = loose.join(large, "loose", "left_anti").select(F.col("loose").alias("unit"), "node")
    sizes = checkpointed(texts.join(crowded.select("node"), "node", "left_semi").mapInArrow(_sizes(width), "node long, size long"))
    edges = verify(texts.join(whole.unionByName(_blocks(crowded, sizes, similarity)), "node"))
    return connected_components(edges.select(F.col("root").alias("a"), F.col("node").alias("b")))


def _content(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _node(text: Column) -> Column:
    return F.xxhash64(_content(text))


def _second(text: Column) -> Column:
    """Another hash of a text, which tells texts of equal first hash apart."""
    return F.xxhash64(F.lit("second"), F.reverse(_content(text)))


def _anchored(prints: DataFrame) -> DataFrame:
    """(a, b): ties that keep together all nodes whose fingerprints (node, fp) are linked by the anchors of SimHash."""
    heads = checkpointed(prints.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    equal = prints.join(heads.where("n > 1"), "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    head = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    near = linked(heads.select("fp")).join(head("a"), "a").join(head("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    return equal.unionByName(near)


def _far(ties: DataFrame, prints: DataFrame) -> DataFrame:
    """The ``ties`` (a, b) whose fingerprints differ in more bits than those that meet at anchors."""
    of = lambda end: prints.select(F.col("node").alias(end), F.col("fp").alias(f"{end}_fp"))
    told = ties.distinct().join(of("a"), "a").join(of("b"), "b")
    return told.where(F.bit_count(F.col("a_fp").bitwiseXOR(F.col("b_fp"))) > THRESHOLD).select("a", "b")


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, node, other, component_id) of each row; component_id is the smallest key of its group.

    ``node`` and ``other`` are hashes that stand for all rows of equal text.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{key}`").alias("id"), _content(F.col(f"`{text}`")).alias("text")).withColumn("node", _node(F.col("text")))
    members = checkpointed(own.select("id", "node", _second(F.col("text")).alias("other"), F.length("text").alias("chars")))
    nodes = checkpointed(members.groupBy("node").agg(F.min("id").alias("least"), F.max("chars").alias("chars"), (F.min("other") == F.max("other")).alias("clear")))
    rows = own.select("node", "text")
    counts = rows.select("text").mapInArrow(_frequencies(width, similarity), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    often = np.zeros(COUNTED, dtype=np.int64)
    told = counts.toArrow()  # a row for each bucket at most
    often[told["bucket"].to_numpy()] = told["n"].to_numpy()
    spread = rows.mapInArrow(_spread(width, similarity, spark.sparkContext.broadcast(often)), "key long, node long, low long, high long")
    stars = spread.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars(similarity), "a long, b long")
    prints = checkpointed(fingerprints(rows, "text", "node", width).groupBy("node").agg(F.min("fp").alias("fp")))
    loose = connected_components(_anchored(prints).unionByName(_far(stars, prints))).withColumnRenamed("root", "loose").join(nodes.where("clear"), "node")
    loose = checkpointed(loose.select("loose", "node", "least", "chars"))
    # One row of each candidate: that of its least id.
    chosen = lambda node, least: F.xxhash64(node, least)
    marks = checkpointed(sieve(loose.select(chosen("node", "least").alias("mark")), "mark"))
    texts = sifted(own.withColumn("mark", chosen("node", "id")), "mark", marks)
    mine = loose.select(F.col("node").alias("n"), F.col("least").alias("l"))
    texts = texts.join(mine, (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("l"))).select("node", "text")
    roots = _links(texts, loose, width, similarity)
    placed = checkpointed(nodes.where("clear").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(heads, "root").select("node", "component_id")
    if not nodes.where("not clear").head(1):
        found = members.join(named, "node")
    else:
        copies = members.groupBy("node", "other").agg(F.min("id").alias("copy"))
        found = members.join(copies, ["node", "other"]).join(named, "node", "left").withColumn("component_id", F.coalesce("component_id", "copy"))
    return found.select(F.col("id").alias(key), "node", "other", "component_id")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the row of the smallest key of each group; rows repeated in key and text count once.

    Rows whose text is not in the sieve of the texts that go, or repeat, are passed on as they are read.
    Columns may have any names.
    """
    groups = similar_groups(docs, text, key, width, similarity).withColumnRenamed(key, "id")
    groups = checkpointed(groups.groupBy("id", "node", "other").agg(F.first("component_id").alias("component_id"), F.count("*").alias("n")))
    stays = F.col("id").eqNullSafe(F.col("component_id"))
    marks = checkpointed(sieve(groups.where(~stays | (F.col("n") > 1)), "node"))
    node, other, kept_id, kept_node, kept_other = fresh(docs.columns, "node", "other", "kept_id", "kept_node", "kept_other")
    rows = docs.withColumn(node, _node(F.col(f"`{text}`")))
    free, bound = sifted(rows, node, marks, held=False), sifted(rows, node, marks).withColumn(other, _second(F.col(f"`{text}`")))
    kept = groups.where(stays).select(F.col("id").alias(kept_id), F.col("node").alias(kept_node), F.col("other").alias(kept_other))
    same = F.col(f"`{key}`").eqNullSafe(F.col(kept_id)) & (F.col(node) == F.col(kept_node)) & (F.col(other) == F.col(kept_other))
    held = bound.join(kept, same, "left_semi").dropDuplicates([key, node, other])
    return free.drop(node).unionByName(held.drop(node, other))
