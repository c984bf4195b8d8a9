"""Small files and registries on any file system that Spark reads: text, hashes, vectors, evaluation corpora."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import render_concept


class Storage:
    """Text files under a folder of any Hadoop file system, written by the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self._gateway, self._jvm, self._conf, self.folder = spark.sparkContext._gateway, spark._jvm, spark._jsc.hadoopConfiguration(), folder.rstrip("/")

    def _at(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self._conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return bool(fs.exists(path))

    def read_text(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, name: str, text: str, replace: bool = True) -> None:
        """Written beside and then renamed over the old one, so that a reader sees one of the two, whole.

        Without ``replace`` a file that is there makes the rename fail.
        """
        _, path = self._at(name)
        fs, beside = self._at(f"{name}.{uuid.uuid4().hex}.new")
        stream = fs.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = rename.valueOf("OVERWRITE" if replace else "NONE")
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self._conf).rename(beside, path, how)

    def move(self, name: str, to: str) -> None:
        fs, path = self._at(name)
        _, target = self._at(to)
        fs.mkdirs(target.getParent())
        if not fs.rename(path, target):
            raise OSError(f"cannot move {path} to {target}")

    def names(self, name: str) -> list[str]:
        """The files in a folder; none if it is not there. Those that are still being written do not count."""
        fs, path = self._at(name)
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [n for n in found if not n.endswith(".new")]

    def make(self, name: str) -> None:
        fs, path = self._at(name)
        fs.mkdirs(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the one that the cluster shares; see ``spark.checkpoint.dir``."""
    from ..operators.graph import shared_folder

    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A table, or None where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def load_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, hash) as last saved; empty where nothing was saved or what is there cannot be read."""
    try:
        rows = spark.read.parquet(f"{folder}/hashes").select("path", "hash")
        rows.count()
        return rows
    except Exception:  # noqa: BLE001 - a damaged cache only costs work
        return spark.createDataFrame([], "path string, hash string")


def save_hashes(hashes: DataFrame, folder: str) -> None:
    hashes.select("path", "hash").write.mode("overwrite").parquet(f"{folder}/hashes")


def save_vectors(vectors: DataFrame, folder: str, model: str = "") -> None:
    """(slug, vector) with the model's name and the width, as one table."""
    vectors.select("slug", "vector", F.lit(model).alias("model"), F.size("vector").alias("width")).write.mode("overwrite").parquet(f"{folder}/embeddings")


def keep_vectors(rows: DataFrame, folder: str) -> None:
    """Rows of a table of vectors as those of another version."""
    rows.write.mode("overwrite").parquet(f"{folder}/embeddings")


def load_vectors(spark: SparkSession, folder: str) -> DataFrame | None:
    return read_or_none(spark, f"{folder}/embeddings")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a row for each node and edge, then one with the counts; nothing is gathered."""
    own = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("slug").alias("id"), F.col("name").alias("label"))).alias("json"))
    links = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "type", "confidence")).alias("json"))
    counts = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))  # one row each
    return own.unionByName(links).unionByName(counts.select(F.lit("stats").alias("kind"), F.to_json(F.struct("nodes", "edges")).alias("json")))


def write_markdown_files(concepts: DataFrame, folder: str) -> None:
    """One Markdown file in a folder of its own for each concept that is not deleted; others go."""
    live = concepts.where("status <> 'deleted'") if "status" in concepts.columns else concepts
    rows = live.select("slug", render_concept(live).alias("value")).repartition("slug")
    rows.write.mode("overwrite").partitionBy("slug").text(f"{folder}/markdown")


def load_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files: fixture, text, has_truth; expected concepts; expected relationships) of an evaluation folder.

    ``name.md`` is paired with ``name.gt.yaml``; a text without one has ``has_truth`` false.
    """
    name = lambda ending: F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{ending}$", 1)
    read = lambda glob, ending: spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(name(ending).alias("fixture"), F.col("value").alias("text"))
    texts, truth = read("*.md", "md"), read("*.gt.yaml", r"gt\.yaml")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for frame in frames:
            yield pd.DataFrame({"fixture": frame["fixture"], "truth": [json.dumps(yaml.safe_load(t) or {}) for t in frame["text"]]})

    kind = "struct<expected_concepts:array<struct<name:string,slug:string,must_have_tags:array<string>,key_phrases:array<string>>>,expected_relationships:array<struct<source:string,target:string,type:string>>>"
    parsed = truth.mapInPandas(parse, "fixture string, truth string").select("fixture", F.from_json("truth", kind).alias("t"))
    none = F.array().cast("array<string>")
    expected = parsed.select("fixture", F.explode("t.expected_concepts").alias("c")).select("fixture", "c.name", "c.slug", F.coalesce("c.must_have_tags", none).alias("must_have_tags"), F.coalesce("c.key_phrases", none).alias("key_phrases"))
    edges = parsed.select("fixture", F.explode("t.expected_relationships").alias("r")).select("fixture", "r.*")
    known = truth.select(F.col("fixture").alias("f"))
    files = texts.join(known, texts.fixture == known.f, "left").select("fixture", "text", F.col("f").isNotNull().alias("has_truth"))
    return files, expected, edges


def format_results(results: DataFrame) -> Column:
    """A hit as text: place, name, score, and the definition."""
    return F.format_string("%d. %s (%.3f)\n   %s", "rank", "name", "total", F.substring("definition", 1, 200))
