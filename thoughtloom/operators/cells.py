"""Vectors stored in cells, for exact nearest ones by opening few of them.

Centres are fitted to a bounded sample; every vector then goes to the cell of its nearest centre, and a cell knows
how far its furthest vector is from the centre. Within a cell no product with a question q exceeds
q * centre + |q| * radius. A question opens the cells of largest bound, takes the k-th best cosine, and
opens all other cells whose bound reaches it; the result is that of a scan, whatever the centres are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import share_of_best
from .retrieval import dot, unit

#: Vectors that the centres are fitted to, rounds of fitting, the most cells, and cells opened for the threshold.
SAMPLE, ROUNDS, CELLS, FIRST = 20_000, 5, 1024, 4
#: What the bounds are raised by, against rounding.
SLACK = 1e-9


def _fitted(sample: np.ndarray, k: int) -> np.ndarray:
    """k centres by Lloyd's rounds, from evenly chosen vectors of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(ROUNDS):
        near = np.argmax(sample @ centres.T - (centres**2).sum(1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass
class VectorCells:
    """Cells in a folder; rows are (key, vector), keys are unique. Null vectors, and those with null parts, are not stored."""

    spark: SparkSession
    root: str

    @staticmethod
    def _usable(rows: DataFrame) -> DataFrame:
        good = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))
        return rows.where(good).select("key", "vector", unit(F.col("vector")).alias("u"))

    def build(self, rows: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> None:
        """Fits the centres and deals out all vectors."""
        units = self._usable(rows)
        n = units.count()
        drawn = [r[0] for r in units.orderBy(F.xxhash64("key"), "key").limit(sample).select("u").collect()]  # of bounded size
        k = min(len(drawn), cells or min(CELLS, int(np.sqrt(n)) + 1))
        centres = _fitted(np.array(drawn), k) if k else np.zeros((0, 0))
        self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.root}/centres")
        self._deal(units, 0)

    def add(self, rows: DataFrame) -> None:
        """More vectors, into the cells that there are."""
        self._deal(self._usable(rows), 1 + max(r[0] for r in self._reach().select("part").distinct().collect()))

    def _centres(self) -> list[tuple[int, list[float]]]:
        return [tuple(r) for r in self.spark.read.parquet(f"{self.root}/centres").orderBy("cell").collect()]  # at most CELLS

    def _deal(self, units: DataFrame, part: int) -> None:
        told = self.spark.sparkContext.broadcast(np.array([c for _, c in self._centres()]))
        schema = pa.schema([("key", pa.string()), ("cell", pa.int32()), ("away", pa.float64()), ("vector", pa.list_(pa.float64()))])

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = told.value
            half = (centres**2).sum(1) / 2
            for batch in batches:
                u = np.array(batch.column("u").to_pylist())
                if not len(u):
                    continue
                cell = np.argmax(u @ centres.T - half, axis=1)
                away = np.sqrt(((u - centres[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), pa.array(cell, pa.int32()), pa.array(away), batch.column("vector").cast(schema.field("vector").type)], schema=schema)

        dealt = units.mapInArrow(nearest, "key string, cell int, away double, vector array<double>")
        dealt.repartition("cell").write.partitionBy("cell").parquet(f"{self.root}/vectors/part={part}")
        rows = self._vectors().where(F.col("part") == part)
        rows.groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).write.parquet(f"{self.root}/reach/part={part}")

    def _vectors(self) -> DataFrame:
        return self.spark.read.schema("key string, away double, vector array<double>, part int, cell int").parquet(f"{self.root}/vectors")

    def _reach(self) -> DataFrame:
        return self.spark.read.schema("cell int, radius double, n bigint, part int").parquet(f"{self.root}/reach")

    def nearest(self, question: list[float], top: int = 50, digits: int = 12) -> DataFrame:
        """(key, cosine, score): as ``vector_scores`` gives them."""
        rows, _ = self._nearest(question, top, digits)
        return share_of_best(rows, "cosine").select("key", "cosine", "score")

    def _nearest(self, question: list[float], top: int, digits: int) -> tuple[DataFrame, list[int]]:
        """The best vectors, and the cells that were opened for them."""
        q = np.array(question, float)
        q = q / np.linalg.norm(q) if np.linalg.norm(q) > 0 else q
        radius = {r[0]: r[1] for r in self._reach().groupBy("cell").agg(F.max("radius")).collect()}  # at most CELLS
        bound = {cell: float(np.dot(q, c) + np.linalg.norm(q) * radius[cell] + SLACK) for cell, c in self._centres() if cell in radius}
        asked = F.array(*(F.lit(float(x)) for x in question)).cast("array<double>")
        cosine = F.round(dot(unit(F.col("vector")), unit(asked)), digits)

        def best(cells: list[int]) -> DataFrame:
            return self._vectors().where(F.col("cell").isin(cells)).select("key", cosine.alias("cosine")).orderBy(F.desc("cosine"), "key").limit(top)

        order = sorted(bound, key=lambda c: (-bound[c], c))
        first = best(order[:FIRST]).agg(F.min("cosine"), F.count("*")).head() if order else (None, 0)
        opened = [c for c in order if first[1] < top or bound[c] >= first[0] - 10.0**-digits]
        return best(opened), opened
