"""Every concept's name and tags asked of all concepts at once: the scores that decide the best answers.

The pairs of a question and a concept are far more than the concepts, so they are never rows. Concepts are numbered;
questions are dealt into blocks and concepts into ranges, and a unit of one block and one range gets the word lists and
edges that lead from the one to the other. There each question's sums are taken in arrays, and only the concepts that can be
among its best go on. What is moved are word lists and edges, once for a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import HOPS, outgoing, stored
from .retrieval import SEEDS, concept_text, tokens

#: Concepts in a piece of a word's list, and in a range at most; entries of word lists or edges that a unit holds on average; the most and the least questions of a block.
CHUNK, RANGE, ENTRIES, MOST, LEAST = 1 << 12, 1 << 17, 1 << 22, 1 << 12, 1 << 10
#: How near sums and shares are to each other when rounding to nine digits, with weights of a tenth at least, may change their order.
NEAR = 4e-8

_UNIT = "unit int, phase int, key int, word string, seed int, x double, y double, ids array<int>, vals array<double>"
#: The phases of a unit's rows: lists of a word, edges of a node into the range, all edges of a seed, words and seeds of a question.
LISTS, EDGES, HOPS_OF, WORDS, STARTS = range(5)


def numbered(slugs: DataFrame) -> DataFrame:
    """(slug, id): numbers from 0 on without gaps, in the order of the slugs."""
    rows = stored(slugs.distinct().sort("slug").select("slug", F.monotonically_increasing_id().alias("at")))
    part, firsts, first = F.shiftright("at", 33), [], 0
    for p, n in sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect())):  # a row for each partition
        firsts.append((p, first))
        first += n
    starts = rows.sparkSession.createDataFrame(firsts, "part long, first long")
    return rows.join(F.broadcast(starts), part == F.col("part")).select("slug", (F.col("first") + F.col("at") - F.shiftleft("part", 33)).cast("int").alias("id"))


class _Rows:
    """Rows of a unit in the order of a key, their arrays laid end to end."""

    def __init__(self, table: pa.Table, phase: int, key: str) -> None:
        table = table.filter(pc.equal(table.column("phase"), phase)).sort_by(key).combine_chunks()
        self.keys, ids = table.column(key), table.column("ids")
        flat = lambda c, kind: pc.list_flatten(table.column(c)).to_numpy().astype(kind, copy=False)
        self.ids, self.vals = flat("ids", np.int64), flat("vals", np.float64)
        sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
        self.ends = np.cumsum(sizes, dtype=np.int64)
        self.starts = self.ends - sizes
        self.table = table

    def numbers(self, column: str) -> np.ndarray:
        return self.table.column(column).to_numpy()

    def slices(self) -> dict:
        """Of each key the stretch of its arrays."""
        out: dict = {}
        for key, a, b in zip(self.keys.to_pylist(), self.starts.tolist(), self.ends.tolist()):
            out[key] = (out[key][0] if key in out else a, b)
        return out


class _Unit:
    """A block of questions and a range of concepts, from ``low`` to ``high``."""

    def __init__(self, table: pa.Table, low: int, high: int) -> None:
        self.low, self.high = low, high
        self.lists, self.edges, self.hops = _Rows(table, LISTS, "word"), _Rows(table, EDGES, "key"), _Rows(table, HOPS_OF, "key")
        self.words, self.seeds = self.lists.slices(), self.hops.slices()
        self.mids, self.back = self.edges.numbers("key"), dict(zip(self.hops.keys.to_pylist(), self.hops.numbers("y").tolist()))
        asked, starts = _Rows(table, WORDS, "key").table, _Rows(table, STARTS, "key").table
        self.asked: dict[int, list] = {}
        self.starts: dict[int, list] = {}
        for q, w, idf, times in sorted(zip(*(asked.column(c).to_pylist() for c in ("key", "word", "x", "y")))):
            self.asked.setdefault(q, []).append((w, idf, times))
        for q, seed, sigma in sorted(zip(*(starts.column(c).to_pylist() for c in ("key", "seed", "x")))):
            self.starts.setdefault(q, []).append((seed, sigma))

    def by_words(self, q: int) -> tuple[np.ndarray, np.ndarray, float]:
        """The concepts that hold a word of the question, their sums, and what no sum exceeds."""
        asked = self.asked.get(q, ())
        met = [(*self.words[w], idf, times) for w, idf, times in asked if w in self.words]
        if not met:
            return np.empty(0, np.int64), np.empty(0), 0.0
        items = np.concatenate([self.lists.ids[a:b] for a, b, _, _ in met])
        found, place = np.unique(items, return_inverse=True)
        return found, np.bincount(place, weights=np.concatenate([self.lists.vals[a:b] * idf * times for a, b, idf, times in met])), sum(idf * times for _, idf, times in asked)

    def by_edges(self, q: int) -> tuple[np.ndarray, float]:
        """What the question's seeds bring to each concept of the range in at most two hops, and what no concept gets more than."""
        starts = self.starts.get(q, ())
        seeds, sigma = np.array([s for s, _ in starts], np.int64), np.array([x for _, x in starts], np.float64)
        spans = [self.seeds.get(s, (0, 0)) for s in seeds.tolist()]
        mids, sure = (np.concatenate([a[i:j] for i, j in spans]) if spans else a[:0] for a in (self.hops.ids, self.hops.vals))
        share = np.repeat(sigma, [j - i for i, j in spans])
        via, place = np.unique(mids, return_inverse=True)
        strength = np.bincount(place, weights=share, minlength=len(via)) * HOPS[2]
        most = HOPS[0] + HOPS[1] * share.sum() + strength.sum()
        at = np.minimum(np.searchsorted(self.mids, via), max(len(self.mids) - 1, 0))
        known = self.mids[at] == via if len(self.mids) else np.zeros(len(via), bool)
        at, strength = at[known], strength[known]
        sizes = self.edges.ends[at] - self.edges.starts[at]
        places = np.repeat(self.edges.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        total = np.bincount(self.edges.ids[places] - self.low, weights=self.edges.vals[places] * np.repeat(strength, sizes), minlength=self.high - self.low).astype(np.float64)  # whole numbers where nothing is counted
        own = (mids >= self.low) & (mids < self.high)
        np.add.at(total, mids[own] - self.low, HOPS[1] * share[own] * sure[own])
        back = np.array([self.back.get(s, 0.0) for s in seeds.tolist()])  # a seed isn't met again by way of its own edges
        own = (seeds >= self.low) & (seeds < self.high)
        np.add.at(total, seeds[own] - self.low, sigma[own] * (HOPS[0] - HOPS[2] * back[own]))
        return total, most

    def first(self, q: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The concepts that may be among the k best by words, the smaller ones of equals, with their sums."""
        items, sums, most = self.by_words(q)
        if len(items) > k:
            near = np.flatnonzero(sums >= np.partition(sums, -k)[-k] - NEAR * most)
            order = near[np.argsort(-sums[near], kind="stable")]
            new = np.r_[True, np.diff(sums[order]) != 0]
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            order = order[rank < k]
            items, sums = items[order], sums[order]
        return items, sums

    def contenders(self, q: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The concepts that may be among the k best for some weights, and the question itself, with both sums.

        The k-th best total is at least the weighted k-th best of each component, so a total reaches it only if its shares of those add up to 1.
        """
        items, sums, most = self.by_words(q)
        total, bound = self.by_edges(q)
        keyword = np.zeros(len(total))
        keyword[items - self.low] = sums
        mine = q - self.low if self.low <= q < self.high else None
        own = (keyword[mine], total[mine]) if mine is not None else (0.0, 0.0)
        if mine is not None:
            keyword[mine] = total[mine] = 0.0
        shares, slack = np.zeros(len(total)), 1e-6
        for x, top in ((keyword, most), (total, bound)):
            some = np.flatnonzero(x > 0)
            kth = np.partition(x[some], -k)[-k] if len(some) >= k else 0.0
            if kth > 0:
                slack = max(slack, NEAR * top / kth)
                shares[some] += x[some] / kth
            else:
                shares[some] += 1.0
        kept = np.flatnonzero(shares >= max(1 - slack, 1e-300))
        if max(own) > 0:
            keyword[mine], total[mine] = own
            kept = np.append(kept, mine)
        return kept + self.low, keyword[kept], total[kept]


def _found(kernel: str, k: int, size: int, ranges: int, n: int):
    """(query, item, raw) or (query, item, by_words, by_edges) of the units of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        for unit in pc.unique(table.column("unit")).to_pylist():
            low = unit % ranges * size
            held = _Unit(table.filter(pc.equal(table.column("unit"), unit)), low, min(low + size, n))
            found: list[tuple] = []
            for q in sorted(held.asked):
                one = getattr(held, kernel)(q, k)
                found.append((np.full(len(one[0]), q), *one))
            if found:
                columns = [np.concatenate(c) for c in zip(*found)]
                names = ["query", "item", "by_words", "by_edges"][: len(columns)]
                yield from pa.table([pa.array(c, pa.int32() if i < 2 else pa.float64()) for i, c in enumerate(columns)], names=names).to_batches(1 << 16)

    return run


def _pairs(rows: DataFrame, by: list[str], of: str, value: str) -> DataFrame:
    """``rows`` by ``by``, with the numbers ``of`` in order as ``ids`` and their values as ``vals``."""
    both = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(of).alias("i"), F.col(value).alias("v")))).alias("_l"))
    return both.select(*by, F.col("_l.i").alias("ids"), F.col("_l.v").alias("vals"))


def _as_rows(rows: DataFrame, phase: int, **columns: Column | str) -> DataFrame:
    """``rows`` with the columns of a unit."""
    kinds = [c.split(" ") for c in _UNIT.split(", ")]
    given = {"unit": "unit", "phase": F.lit(phase), **columns}
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select(*(as_column(given[name]).cast(kind).alias(name) if name in given else F.lit(None).cast(kind).alias(name) for name, kind in kinds))


def best_scores(concepts: DataFrame, edges: DataFrame, k: int, seeds: int = SEEDS) -> DataFrame:
    """(query, item, keyword, semantic, graph): each concept's name and tags asked of all concepts at once.

    Words bring queries and concepts together; each query's walk starts from its own best hits. There are no
    vectors here, so the semantic part is 0. Of the items of a query those are returned that can be among its ``k`` best
    for some weights (each 0, or a tenth and more), and the query itself where it has a score; no query is left out.
    """
    spark = concepts.sparkSession
    ids = stored(numbered(concepts.select("slug").union(edges.select("source")).union(edges.select("target")).where("slug is not null")))
    n = max(ids.count(), 1)
    named = lambda rows, slug, name: rows.join(ids.select(F.col("slug").alias(slug), F.col("id").alias(name)), slug).drop(slug)
    rows = named(concepts.select("slug", tokens(F.concat_ws(" ", "name", F.array_join("tags", " "))).alias("asks"), tokens(concept_text(concepts)).alias("ts")), "slug", "id")
    tf = rows.select(F.col("id").alias("item"), F.size("ts").alias("len"), F.explode("ts").alias("word")).groupBy("item", "len", "word").agg(F.count("*").alias("tf"))
    tf = stored(tf.select("item", "word", (F.col("tf") / F.col("len")).alias("share")))
    total = concepts.where("slug is not null").agg(F.count("*").alias("n"))
    df = tf.groupBy("word").agg(F.count("*").alias("df")).join(F.broadcast(total))  # one row
    idf = df.select("word", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    asked = rows.select(F.col("id").alias("query"), F.explode("asks").alias("word")).groupBy("query", "word").agg(F.count("*").alias("times"))
    asked = stored(asked.join(idf, "word").select("query", "word", "idf", "times"))
    out = outgoing(edges.where("source <> target"))
    out = stored(named(named(out, "source", "a"), "target", "b").select("a", "b", "confidence"))

    entries = max(tf.count(), out.count())
    size = min(RANGE, -(-n * ENTRIES // max(entries, ENTRIES)))
    size = -(-size // CHUNK) * CHUNK  # whole pieces
    ranges = -(-n // size)
    blocks = max(-(-n // MOST), min(2 * spark.sparkContext.defaultParallelism, -(-n // LEAST)))
    block = lambda c: F.pmod(F.col(c), F.lit(blocks))
    spread = F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))
    unit = lambda b, r: (F.col(b) * ranges + F.col(r)).alias("unit")

    def found(parts: list[DataFrame], kernel: str, many: int, columns: str) -> DataFrame:
        units = parts[0]
        for part in parts[1:]:
            units = units.unionByName(part)
        return units.repartitionById(blocks * ranges, "unit").mapInArrow(_found(kernel, many, size, ranges, n), columns)

    lists = stored(_pairs(tf.withColumn("piece", F.expr(f"item div {CHUNK}")), ["word", "piece"], "item", "share"))
    wanted = asked.select("word", block("query").alias("block")).distinct()
    lists = lists.join(wanted, "word").withColumn("range", F.expr(f"piece div {size // CHUNK}"))
    words = _as_rows(lists.select("*", unit("block", "range")), LISTS, word="word", ids="ids", vals="vals")
    questions = asked.select("*", block("query").alias("block"), spread.alias("range"))
    questions = _as_rows(questions.select("*", unit("block", "range")), WORDS, key="query", word="word", x="idf", y="times")

    first = found([words, questions], "first", seeds, "query int, item int, by_words double")
    first = _share_of_best(first, "by_words", "keyword").where("keyword > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("keyword", 9)), "item"))
    starts = first.withColumn("rank", rank).where(F.col("rank") <= seeds)
    starts = stored(starts.select("query", F.col("item").alias("seed"), F.col("keyword").alias("sigma"), block("query").alias("block")))

    turned = out.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("confidence").alias("c"))
    back = out.join(turned, ["a", "b"]).groupBy(F.col("a").alias("seed")).agg(F.sum("c").alias("back"))
    hops = _pairs(out, ["a"], "b", "confidence").withColumnRenamed("a", "seed").join(back, "seed", "left")
    hops = hops.join(starts.select("seed", "block").distinct(), "seed").select("*", spread.alias("range"))
    hops = _as_rows(hops.select("*", unit("block", "range")), HOPS_OF, key="seed", y=F.coalesce("back", F.lit(0.0)), ids="ids", vals="vals")
    into = _pairs(out.withColumn("range", F.expr(f"b div {size}")), ["a", "range"], "b", "confidence")
    into = into.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    into = _as_rows(into.select("*", unit("block", "range")), EDGES, key="a", ids="ids", vals="vals")
    walks = starts.select("*", spread.alias("range"))
    walks = _as_rows(walks.select("*", unit("block", "range")), STARTS, key="query", seed="seed", x="sigma")

    best = found([words, questions, hops, into, walks], "contenders", k, "query int, item int, by_words double, by_edges double")
    best = _share_of_best(_share_of_best(best, "by_words", "keyword"), "by_edges", "graph")
    return _with_slugs(best, ids).select("query", "item", F.round("keyword", 9).alias("keyword"), F.lit(0.0).alias("semantic"), F.round("graph", 9).alias("graph"))


def _with_slugs(rows: DataFrame, ids: DataFrame) -> DataFrame:
    for name in ("query", "item"):
        rows = rows.withColumnRenamed(name, "id").join(ids.withColumnRenamed("slug", name), "id").drop("id")
    return rows


def _share_of_best(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """``rows`` with ``name``: ``raw`` over the largest of its query, 0 where none is positive."""
    best = F.max(raw).over(Window.partitionBy("query"))
    return rows.withColumn("_best", best).withColumn(name, F.when(F.col("_best") > 0, F.col(raw) / F.col("_best")).otherwise(0.0)).drop("_best")
