"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear classifier on the presence of hashed words and word beginnings is trained in numpy from
confirmed toxic texts and unlabelled texts only. Its risk corrects for the toxic share ``prior``
hidden in the unlabelled texts,

    R = prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]),

and where the bracket is negative a step goes back along its gradient (Kiryo et al., 2017). Labels
other than "toxic" are never read, except that the share of toxic rows among the labelled ones
estimates ``prior``.

Words are runs of letters and digits, A-Z as a-z; their first 4, 5 and 6 bytes are features too.
Presence is counted once per text, so one insult in a very long text weighs as much as in a short
one. Texts are read whole. A null or empty text has no feature and gets the score of the bias.
Training takes at most ``max_positive`` toxic and ``max_unlabelled`` other texts, those of smallest
id hash; scoring covers every row. Without a toxic row every score is practically 0; where all n
labelled rows are toxic, the share is taken for n / (n + 1). Of rows repeated with one id and other texts
the one of smallest text hash is trained on; all are scored by their own text. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import crc_of_id, hash_order, table

BITS = 22
MAX_POSITIVE, MAX_UNLABELLED = 3000, 6000
#: Features in a smaller share of the positive texts than this are not trained on, nor features
#: whose share of positive texts is less than so many times their share of the others.
MIN_SHARE, MIN_LIFT = 0.004, 1.5


def _tokens(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(feature numbers, their text, texts), once per occurrence."""
    words = wh.Words(data, offsets, wh.NOT_WORD)
    idx, doc = [wh.bucket(words.hashes(), bits, 11)], [words.text]
    for size in (4, 5, 6):
        which, hashes = words.prefixes(size)
        idx.append(wh.bucket(hashes, bits, 11 + size))
        doc.append(words.text[which])
    return np.concatenate(idx), np.concatenate(doc), len(words.counts)


def featurise(rows: DataFrame, text: str, keep: str, bits: int) -> DataFrame:
    """``keep`` (an int column) with the distinct features ``idx`` of each text."""

    def run(batches):
        for batch in batches:
            for at, data, offsets in wh.text_slices(batch.column(text)):
                idx, doc, n = _tokens(data, offsets, bits)
                cell = np.unique((doc << bits) | idx)
                bounds = pa.array(np.searchsorted(cell >> bits, np.arange(n + 1)).astype(np.int32))
                lists = pa.ListArray.from_arrays(bounds, pa.array((cell & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(keep).slice(at, n), lists], names=[keep, "idx"])

    return rows.select(keep, text).mapInArrow(run, f"{keep} int, idx array<int>")


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 240, rate: float = 0.1, l2: float = 2e-4, beta: float = 0.0) -> tuple[np.ndarray, np.ndarray, float]:
    """(feature numbers, weights, bias) of the nnPU classifier, by full-batch Adam.

    Only features of a sufficient share of the positive texts that are relatively more frequent
    there than in unlabelled texts can speak for toxicity; the others are dropped before training.
    """
    texts = [*positive, *unlabelled]
    width = max((int(x[-1]) for x in map(np.sort, texts) if len(x)), default=-1) + 1
    in_positive, in_other = np.zeros(width), np.zeros(width)
    for k, x in enumerate(texts):  # text by text, so that nothing as long as all texts together is made
        (in_positive if k < len(positive) else in_other)[x] += 1
    least = max(2, MIN_SHARE * len(positive)) if len(positive) > 20 else 1
    lift = (in_positive / len(positive)) / np.maximum((in_other + 1) / (len(unlabelled) + 1), 1e-12)
    names = np.flatnonzero((in_positive >= least) & (lift > MIN_LIFT))
    place = np.full(width, -1, dtype=np.int32)
    place[names] = np.arange(len(names))
    kept = [(at := place[x])[at >= 0] for x in texts]
    row, col = np.repeat(np.arange(len(texts)), [len(x) for x in kept]), np.concatenate(kept)
    n, m = len(texts), len(names)
    w, b = np.zeros(m), float(np.log(prior / (1 - prior)))
    first, second, k = np.zeros(m + 1), np.zeros(m + 1), np.arange(n) < len(positive)
    mean_w, mean_b, averaged = np.zeros(m), 0.0, steps // 3
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    loss = lambda x: np.logaddexp(0, -x)
    for step in range(1, steps + 1):
        f = np.bincount(row, weights=w[col], minlength=n) + b
        negative = loss(-f[~k]).mean() - prior * loss(-f[k]).mean()
        d_pos, d_neg = np.zeros(n), np.zeros(n)
        d_pos[k] = -prior * sigmoid(-f[k]) / k.sum()
        d_neg[~k] = sigmoid(f[~k]) / (~k).sum()
        d_neg[k] = -prior * sigmoid(f[k]) / k.sum()
        d = d_pos + d_neg if negative >= -beta else -d_neg
        g = np.append(np.bincount(col, weights=d[row], minlength=m) + l2 * w, d.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (1.02 - step / steps) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        if step > steps - averaged:  # the last third of the path, averaged, is free of its swings
            mean_w, mean_b = mean_w + w / averaged, mean_b + b / averaged
    return names, mean_w, float(mean_b)


@dataclass
class ToxicityModel:
    names: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, docs: DataFrame, text: str = "text", column: str = "score") -> DataFrame:
        """``docs`` with a score in [0, 1] in ``column``; a column of that name is replaced."""
        keep = [f for f in docs.schema.fields if f.name != column]
        names = [f.name for f in keep]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{column}` double"])
        model, bias, bits = docs.sparkSession.sparkContext.broadcast((self.names, self.weights)), self.bias, self.bits

        def run(batches):
            weights = np.zeros(1 << bits, dtype=np.float32)
            weights[model.value[0]] = model.value[1]
            for batch in batches:
                found = [np.zeros(0)]
                for _, data, offsets in wh.text_slices(batch.column(text)):
                    idx, doc, n = _tokens(data, offsets, bits)
                    known = np.flatnonzero(weights[idx])
                    cell = np.unique((doc[known] << bits) | idx[known])
                    dot = np.bincount(cell >> bits, weights=weights[cell & ((1 << bits) - 1)], minlength=n)
                    found.append(1 / (1 + np.exp(-np.clip(dot + bias, -700, 35))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(found))], names=[*names, column])

        return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def held_out() -> Column:
    return (crc_of_id() % 5) == 0


def fit_toxicity(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> ToxicityModel:
    """A model from documents and the labels outside the held-out fold.

    At most ``max_positive + max_unlabelled`` ids are sent to the executors, and as many sets of
    features come back. Unlabelled texts are drawn from all documents of the training folds,
    whatever is known of them.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = known.agg(F.avg("toxic").alias("share"), F.count("*").alias("n")).head()
    share = min(told["share"] or 0.0, told["n"] / (told["n"] + 1))
    order = [hash_order("doc_id"), F.col("doc_id")]
    toxic = known.where("toxic = 1").orderBy(*order).limit(max_positive).select("doc_id", F.lit(1).alias("part"))
    others = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(*order).limit(max_unlabelled)
    others = others.select("doc_id", F.lit(0).alias("part"))
    # The risk asks for unlabelled texts as they come: a positive one may be among them, too.
    ids = toxic.unionByName(others)
    # of an id with several texts one takes part, so that no more than the bound come back
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sets: tuple[list, list] = ([], [])
    found = featurise(sample, "text", "part", bits).toArrow()
    for batch in found.to_batches():
        values, bounds = batch.column("idx").values.to_numpy(), batch.column("idx").offsets.to_numpy()
        for part, begin, end in zip(batch.column("part").to_pylist(), bounds, bounds[1:]):
            sets[part].append(values[begin:end])
    if not sets[1] or not share:
        return ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0), -800.0, bits)
    names, weights, bias = fit_nnpu(sets[1], sets[0] or [np.zeros(0, dtype=np.int64)], share)
    return ToxicityModel(names, weights, bias, bits)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = fit_toxicity(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
