"""Exact top-k inner-product search with a three-phase uniform threshold (Cao & Wang, 2004).

The dimensions are split into LISTS ranges. Each is a score list: its partial score for a query
orders the candidates, and a candidate's score is the sum over the lists.

1. Every task opens its first list only: the k candidates of the best partial scores are sent with
   their full scores. The k-th best of what is gathered for a query is a safe cutoff ``tau``.
2. The cutoffs are broadcast. Lists are opened one after the other, each for the candidates that may
   still count. An entry is sufficient in a list if its partial score is tau / LISTS or more; one that
   is sufficient nowhere, nor can be in a list still closed, has a score under tau. And one whose
   partial scores so far, with the most that the closed lists can add (the product of the norms of
   both sides there), lie under tau has, too. Such entries are dropped; their other lists stay closed.
3. What is left after the last list has its exact score; the k best of each task are merged.

Vectors are integers: floor(scale * x). Queries are sent to the tasks in batches of at most
``batch_bytes``; each batch passes over all candidates, in blocks, and no candidate is moved. Only k
entries per query and task leave a task. Products are taken in float64 where they are exact and in
Python integers beyond that; bounds have a margin for rounding.

Vectors that are null or hold a null or non-finite component take no part, nor do rows of null id.
Shorter vectors count as padded with zeros. Where an id is repeated, every row is a candidate, rows
of the query's own id are not, and the query's vector is the smallest. Ties go to the smaller id;
identical (id, score) pairs may fill several ranks. Scores beyond 64 bits are reported as the
largest or smallest long. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

LISTS = 8
#: From this share of open entries on, further lists are opened entry by entry and no more by blocks.
SPARSE = 0.1
#: Bytes of the queries of one batch, and scores that a task has in hand at once.
BATCH_BYTES, SCORES = 1 << 25, 1 << 22


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, cut or padded to ``width``: float64 or, if too large for it, objects."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)
    fits = place < width
    out[row[fits], place[fits]] = flat[offsets[0] : offsets[-1]][fits]
    return out


def _product(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products as int64, or as Python integers where they may not fit."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ candidates.T.astype(np.float64)).astype(np.int64)
    return queries.astype(object) @ candidates.T.astype(object)


def _lists(width: int) -> list[slice]:
    edges = np.linspace(0, width, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:]) if a < b] or [slice(0, 0)]


def _norms(vectors: np.ndarray, lists: list[slice]) -> np.ndarray:
    """The norm of each vector in each list, with a margin for rounding."""
    return np.stack([np.sqrt((vectors[:, p].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-7) for p in lists], axis=1)


def _pairs(queries: np.ndarray, vectors: np.ndarray, q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The inner product of query q[i] and candidate c[i], for each i."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**63:
        return np.einsum("ij,ij->i", queries[q], vectors[c])
    return np.array([sum(int(x) * int(y) for x, y in zip(queries[i], vectors[j])) for i, j in zip(q, c)], dtype=object)


def first_entries(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score): for each query the k candidates that lead its first list."""
    part = _product(queries[:, _lists(queries.shape[1])[0]], vectors[:, _lists(queries.shape[1])[0]])
    part = np.where(own[:, None] == ids[None, :], float("-inf"), part.astype(np.float64))
    n = min(k, len(ids))
    best = np.argpartition(-part, n - 1, axis=1)[:, :n] if n < len(ids) else np.tile(np.arange(n), (len(queries), 1))
    q, c = np.repeat(np.arange(len(queries)), n), best.ravel()
    other = own[q] != ids[c]
    q, c = q[other], c[other]
    return q, c, _pairs(queries, vectors, q, c)


def sufficient_entries(queries: np.ndarray, own: np.ndarray, taus: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, candidate, score) of all entries of at least tau, and how many partial scores were taken.

    A tau of minus infinity keeps everything.
    """
    lists = _lists(queries.shape[1])
    norms_q, norms_c = _norms(queries, lists), _norms(vectors, lists)
    share = taus / len(lists)
    alive = own[:, None] != ids[None, :]
    total, enough, opened, j = None, np.zeros(alive.shape, dtype=bool), 0, 0
    while j < len(lists) and alive.mean() > (SPARSE if j else 0):
        score = _product(queries[:, lists[j]], vectors[:, lists[j]])
        opened, j = opened + score.size, j + 1
        total = score if total is None else total + score
        enough |= score >= share[:, None]
        more = norms_q[:, j:] @ norms_c[:, j:].T
        alive &= total.astype(np.float64) + more * (1 + 1e-9) + 1 >= taus[:, None]
        if j < len(lists):
            most = norms_q[:, j:].max(axis=1)[:, None] * norms_c[:, j:].max(axis=1)[None, :]
            alive &= enough | (most + 1 >= share[:, None])
    q, c = np.nonzero(alive)
    score = total[q, c] if total is not None else np.zeros(0, dtype=np.int64)
    while j < len(lists) and len(q):
        score = score + _pairs(queries[:, lists[j]], vectors[:, lists[j]], q, c)
        opened, j = opened + len(q), j + 1
        more = (norms_q[q, j:] * norms_c[c, j:]).sum(axis=1)
        held = np.flatnonzero(score.astype(np.float64) + more * (1 + 1e-9) + 1 >= taus[q])
        q, c, score = q[held], c[held], score[held]
    good = np.flatnonzero(score >= taus[q])
    return q[good], c[good], score[good], opened


class _Best:
    """The k best entries of each query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.held = k, []

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.held.append((q, ids, score))
        if sum(len(x[0]) for x in self.held) > SCORES:
            self.held = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        q, ids, score = (np.concatenate(x) for x in zip(*self.held))
        if score.dtype == object:
            order = np.array(sorted(range(len(q)), key=lambda i: (q[i], -score[i], ids[i])), dtype=np.int64)
        else:
            order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        new = np.append(True, q[1:] != q[:-1])
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        return q[rank < self.k], ids[rank < self.k], score[rank < self.k]


def _phase(batch_of, k: int, collect: bool):
    """Blocks of candidates against one batch of queries: (query_id, vec_id, score) of the k best."""

    def run(batches):
        own, queries, taus = batch_of.value
        best = _Best(k)
        for batch in batches:
            ids, column = batch.column("id").to_numpy(zero_copy_only=False), batch.column("v")
            if not len(ids):
                continue
            width = max(queries.shape[1], int(np.diff(column.offsets.to_numpy()).max(initial=0)))
            vectors = _matrix(column, width)
            asked = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
            step = max(1, SCORES // len(ids))
            for at in range(0, len(own), step):
                some = slice(at, at + step)
                if collect:
                    q, c, score, _ = sufficient_entries(asked[some], own[some], taus[some], vectors, ids)
                else:
                    q, c, score = first_entries(asked[some], own[some], vectors, ids, k)
                best.add(at + q, ids[c], score)
        q, ids, score = best.merged()
        columns = own[q], ids, np.clip(score, -(2**63), 2**63 - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in columns], names=["query_id", "vec_id", "score"])

    return run


def _batches(asked: DataFrame, batch_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries, at most ``batch_bytes`` (or one query) at a time."""
    ids, vectors, size = [], [], 0

    def batch():
        width = max(len(v) for v in vectors)
        return np.array(ids, dtype=np.int64), np.array([v + [0] * (width - len(v)) for v in vectors], dtype=np.int64).reshape(len(ids), width)

    for r in asked.toLocalIterator():
        if ids and size + 8 * (len(r["v"]) + 1) > batch_bytes:
            yield batch()
            ids, vectors, size = [], [], 0
        ids.append(r["id"])
        vectors.append(list(r["v"]))
        size += 8 * (len(r["v"]) + 1)
    if ids:
        yield batch()


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query, its own id excluded."""
    spark = candidates.sparkSession
    prepare = lambda df: df.select(F.col(f"`{key}`").cast("long").alias("id"), quantised(F.col(f"`{vector}`"), scale).alias("v")).where("id is not null and v is not null")
    pool = prepare(candidates)
    asked = checkpointed(prepare(queries).groupBy("id").agg(F.min("v").alias("v")))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    entries = "query_id long, vec_id long, score long"
    found = []
    for own, vectors in _batches(asked, batch_bytes):
        send = spark.sparkContext.broadcast
        gathered = pool.mapInArrow(_phase(send((own, vectors, None)), k, collect=False), entries)
        cutoff = gathered.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k).select("query_id", "score")
        taus = np.full(len(own), float("-inf"))
        place = {int(x): i for i, x in enumerate(own)}
        for r in cutoff.toLocalIterator():  # one number for each query of the batch
            tau = float(r["score"])
            if abs(tau) >= 2**53:  # never above the cutoff itself, nor above a score that was cut to 64 bits
                tau = np.nextafter(tau, float("-inf")) if tau > -(2.0**63) else float("-inf")
            taus[place[r["query_id"]]] = tau
        sufficient = pool.mapInArrow(_phase(send((own, vectors, taus)), k, collect=True), entries)
        ranked = sufficient.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        found.append(checkpointed(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
