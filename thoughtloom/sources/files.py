"""Readers and writers: transcripts, concept stores, graphs, vectors, snapshots, Markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.parsing import parse_turns

Reader = Callable[[SparkSession, str], DataFrame]
_READERS: dict[str, Reader] = {}


def register_reader(extension: str, reader: Reader) -> None:
    """Names the function that reads files of an extension to (source_file, text)."""
    _READERS[extension.lower().lstrip(".")] = reader


def reader_for(extension: str) -> Reader:
    try:
        return _READERS[extension.lower().lstrip(".")]
    except KeyError:
        raise ValueError(f"no reader for {extension!r}; there are {sorted(_READERS)}") from None


def registered_extensions() -> list[str]:
    return sorted(_READERS)


def _whole_texts(extension: str) -> Reader:
    def read(spark: SparkSession, folder: str) -> DataFrame:
        rows = spark.read.option("pathGlobFilter", f"*.{extension}").text(folder, wholetext=True)
        return rows.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))

    return read


def page_text(html: Column) -> Column:
    """The visible text of a page: scripts, styles and tags go, block ends become line ends."""
    body = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " ")
    lines = F.regexp_replace(body, r"(?i)<(?:/p|/div|/li|/h[1-6]|br\s*/?)>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", "")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    return plain


for _extension in ("md", "txt"):
    register_reader(_extension, _whole_texts(_extension))
register_reader("html", lambda spark, folder: _whole_texts("html")(spark, folder).withColumn("text", page_text(F.col("text"))))


def read_transcripts(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md", "txt")) -> DataFrame:
    """Turns of all transcripts directly in a folder."""
    files = [reader_for(e)(spark, folder) for e in extensions]
    out = files[0]
    for more in files[1:]:
        out = out.unionByName(more)
    return parse_turns(out)


def render_concept(concepts: DataFrame) -> Column:
    """A concept as Markdown with a header, for the columns that there are."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    some = lambda c, out: [F.when(F.size(c) > 0, out)] if c in concepts.columns else []
    items = lambda c, f: F.array_join(F.transform(c, f), "\n")
    head = F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("title: "), quoted(F.col("name"))),
        F.concat(F.lit("slug: "), quoted(F.col("slug"))),
        *some("tags", F.concat(F.lit("tags: ["), F.array_join("tags", ", "), F.lit("]"))),
        F.format_string("confidence: %.2f", F.col("confidence")),
        *some("source_files", F.concat(F.lit("sources:\n"), items("source_files", lambda s: F.concat(F.lit('  - "'), s.cast("string"), F.lit('"'))))),
        F.lit("---"),
    )
    section = lambda title, body: F.concat(F.lit(f"## {title}\n\n"), body)
    explained = [F.when((F.col("explanation") != "") & (F.col("explanation") != F.col("definition")), section("Explanation", F.col("explanation")))] if "explanation" in concepts.columns else []
    parts = [
        head,
        F.concat(F.lit("# "), F.col("name")),
        section("Definition", F.col("definition")),
        *explained,
        *some("insights", section("Key Insights", items("insights", lambda s: F.concat(F.lit("- "), s)))),
        *some("examples", section("Examples", items("examples", lambda s: F.when(s.startswith("```"), s).otherwise(F.concat(F.lit("- "), s))))),
        *some("links", section("Related Concepts", items("links", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))))),
        *some("relationships", section("Relationships", items("relationships", lambda r: F.concat(F.lit("- **"), r["type"], F.lit("**: [["), r["target"], F.lit("]]"))))),
    ]
    return F.concat(F.concat_ws("\n\n", *parts), F.lit("\n"))


def write_store(concepts: DataFrame, folder: str) -> None:
    """The store as a table; a Markdown column can be exported from it at any time."""
    concepts.write.mode("overwrite").parquet(f"{folder}/concepts")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/concepts")


def write_markdown(concepts: DataFrame, folder: str) -> None:
    """One row of text per concept that is not deleted, in files by first letter of the slug."""
    live = concepts.where("status <> 'deleted'") if "status" in concepts.columns else concepts
    live.select(F.substring("slug", 1, 1).alias("initial"), "slug", render_concept(concepts).alias("markdown")).write.mode("overwrite").partitionBy("initial").json(f"{folder}/markdown")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/graph/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/graph/edges")


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/graph/nodes"), spark.read.parquet(f"{folder}/graph/edges")


def append_snapshot(concepts: DataFrame, folder: str, provider: str, ts: Column) -> None:
    """Adds (ts, provider, slug, hash) of the store, deleted concepts included."""
    concepts.select(ts.alias("ts"), F.lit(provider).alias("provider"), "slug", "hash").write.mode("append").parquet(f"{folder}/snapshots")


def append_run(spark: SparkSession, folder: str, provider: str, ts: Column) -> None:
    """Adds (ts, provider) of a run."""
    spark.range(1).select(ts.alias("ts"), F.lit(provider).alias("provider")).write.mode("append").parquet(f"{folder}/runs")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/snapshots")


def provenance_json(concepts: DataFrame) -> DataFrame:
    """(slug, json): a JSON document of the places of each concept that has some, null fields left out."""
    rows = concepts.where(F.size("sources") > 0)
    return rows.select("slug", F.to_json(F.struct("slug", "name", "sources")).alias("json"))


def write_provenance(concepts: DataFrame, folder: str) -> None:
    """A line of JSON for each concept that has sources."""
    provenance_json(concepts).select(F.col("json").alias("value")).write.mode("overwrite").text(f"{folder}/provenance")
