"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

Features of a text are its white-space separated words, their pairs, the kinds of characters of a
word ("!!" after capitals, bars, runs of signs), pairs of these, and whether a word repeats the one
before; each is hashed into ``2 ** bits`` columns. A feature's value is its count divided by the
number of words, so a score is one sparse dot product per text, and long texts weigh no more than
short ones. Texts are read whole.

Training takes the ``max_rows`` labelled rows of smallest id hash (a documented bound on what the
driver holds); scoring covers every row. A null text counts as empty; an empty text has no feature
and gets the score of the bias alone. Rows with a null id or label are never trained on. Repeated
rows each get their score; rows of one id and other texts are all trained on. With no labelled row
the model is neutral: every score is 0.5. Other columns are passed on, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import crc_of_id, hash_order, table

BITS = 18
#: The most labelled rows that a model is fitted on.
MAX_ROWS = 8000


def _tokens(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, their text, words of each text); a feature is listed once per occurrence."""
    words = wh.Words(data, offsets, wh.WHITE)
    own, kind, text = words.hashes(), words.classes(), words.text
    later = np.flatnonzero(~words.is_first())
    same = later[own[later] == own[later - 1]]
    parts = [
        (wh.bucket(own, bits, 1), text),
        (wh.bucket(own[later] * np.uint64(3) + own[later - 1], bits, 2), text[later]),
        (wh.bucket(kind, bits, 3), text),
        (wh.bucket(kind[later] * np.uint64(3) + kind[later - 1], bits, 4), text[later]),
        (wh.bucket(np.full(len(same), 1, dtype=np.uint64), bits, 5), text[same]),
    ]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), words.counts


def featurise(rows: DataFrame, text: str, keep: list[str], bits: int) -> DataFrame:
    """``keep`` columns with the sparse vector of each text (``idx``, ``val``)."""
    fields = [rows.schema[c] for c in keep]
    schema = "idx array<int>, val array<float>"
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        for batch in batches:
            for at, data, offsets in wh.text_slices(batch.column(text)):
                idx, doc, counts = _tokens(data, offsets, bits)
                cell, n = np.unique((doc << bits) | idx, return_counts=True)
                doc, idx = cell >> bits, cell & ((1 << bits) - 1)
                bounds = pa.array(np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32))
                val = (n / np.maximum(counts, 1)[doc]).astype(np.float32)
                out = [batch.column(c).slice(at, len(counts)) for c in keep]
                out += [pa.ListArray.from_arrays(bounds, pa.array(idx.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(val))]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "idx", "val"])

    return rows.select(*keep, text).mapInArrow(run, f"{head}, {schema}")


@dataclass
class FTRL:
    """Follow-the-regularised-leader (proximal) for logistic loss, one example at a time."""

    size: int
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.001
    l2: float = 0.01

    def fit(self, examples: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 3) -> tuple[np.ndarray, float]:
        """The weights and the bias, which is the last column of every example."""
        z, n = np.zeros(self.size + 1), np.zeros(self.size + 1)
        for turn in range(passes):
            for k in np.random.default_rng(turn).permutation(len(examples)):
                idx, val, label = examples[k]
                idx, val = np.append(idx, self.size), np.append(val, 1.0)
                w = self._weights(z[idx], n[idx])
                p = 1 / (1 + np.exp(-np.clip(w @ val, -35, 35)))
                g = (p - label) * val
                sigma = (np.sqrt(n[idx] + g * g) - np.sqrt(n[idx])) / self.alpha
                z[idx] += g - sigma * w
                n[idx] += g * g
        w = self._weights(z, n)
        return w[:-1], float(w[-1])

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, docs: DataFrame, text: str = "text", column: str = "score") -> DataFrame:
        """``docs`` with a score in [0, 1] in ``column``; a column of that name is replaced."""
        keep = [f for f in docs.schema.fields if f.name != column]
        names = [f.name for f in keep]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{column}` double"])
        weights, bias, bits = docs.sparkSession.sparkContext.broadcast(self.weights.astype(np.float32)), self.bias, self.bits

        def run(batches):
            for batch in batches:
                found = [np.zeros(0)]
                for _, data, offsets in wh.text_slices(batch.column(text)):
                    idx, doc, counts = _tokens(data, offsets, bits)
                    dot = np.bincount(doc, weights=weights.value[idx], minlength=len(counts))
                    found.append(1 / (1 + np.exp(-np.clip(dot / np.maximum(counts, 1) + bias, -35, 35))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate(found))], names=[*names, column])

        return docs.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def fit_quality(labelled: DataFrame, text: str = "text", label: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS) -> QualityModel:
    """A model from rows (doc_id, text, label 0 or 1), at most ``max_rows`` of them."""
    rows = labelled.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    found = featurise(rows, text, ["doc_id", label], bits).orderBy(hash_order("doc_id"), "doc_id").limit(max_rows)
    examples = [(np.asarray(r["idx"], dtype=np.int64), np.asarray(r["val"], dtype=np.float64), int(r[label])) for r in found.toLocalIterator()]
    if not examples:
        return QualityModel(np.zeros(1 << bits), 0.0, bits)
    weights, bias = FTRL(1 << bits).fit(examples)
    return QualityModel(weights, bias, bits)


def held_out() -> Column:
    return (crc_of_id() % 4) == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held: Column, max_rows: int) -> DataFrame:
    """The texts of at most ``max_rows`` labelled rows outside the held-out fold.

    The rows are chosen by id alone, so only their texts are read into the sample. The ids that
    are sent to every executor are at most ``max_rows``.
    """
    ids = labels.where(~held & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    ids = ids.orderBy(hash_order("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(training_rows(docs, labels, "quality", held_out(), MAX_ROWS), max_rows=MAX_ROWS)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
