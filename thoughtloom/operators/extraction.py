"""Concepts from batches of chunks through a model: the interface, grounding, provenance, counters."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .concepts import RULE_CONFIDENCE, distill_marked, extract_by_rule, is_grounded, json_object, parse_reply
from .graph import stored

#: Fixed value: characters of a batch that a model sees.
PROMPT_CHARS = 6000
TASK = "List the concepts that the text explains, as JSON: {\"concepts\": [{\"name\", \"definition\", \"explanation\", \"insights\", \"examples\", \"tags\", \"relationships\": [{\"target\", \"type\"}]}]}.\n\nTEXT:\n"


class Model(Protocol):
    """What answers a prompt; ``available`` tells whether it can be reached."""

    def available(self) -> bool: ...

    def generate(self, prompt: str, system: str = "") -> str: ...


def http_post(url: str, body: dict, headers: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as reply:
        return json.load(reply)


@dataclass
class HttpModel:
    """A model behind HTTP, in the "ollama" or the "openai" form; ``post`` can be replaced in tests."""

    url: str
    model: str
    form: str = "ollama"
    key: str = ""
    timeout: float = 120.0
    retries: int = 2
    post: Callable[[str, dict, dict, float], dict] = field(default=http_post, repr=False)

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(self.url, timeout=5):
                return True
        except OSError:
            return False

    def generate(self, prompt: str, system: str = "") -> str:
        said = [{"role": r, "content": c} for r, c in (("system", system), ("user", prompt)) if c]
        body = {"model": self.model, "messages": said, "stream": False, **({"format": "json"} if self.form == "ollama" else {})}
        path = "/api/chat" if self.form == "ollama" else "/v1/chat/completions"
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        for turn in range(self.retries + 1):
            try:
                reply = self.post(self.url.rstrip("/") + path, body, headers, self.timeout)
                return (reply["message"] if self.form == "ollama" else reply["choices"][0]["message"])["content"]
            except OSError:
                if turn == self.retries:
                    raise
                time.sleep(2**turn)
        raise AssertionError("unreachable")


@dataclass
class CannedModel:
    """Answers every prompt with what ``answer`` gives for it; for tests."""

    answer: Callable[[str], str]

    def available(self) -> bool:
        return True

    def generate(self, prompt: str, system: str = "") -> str:
        return self.answer(prompt)


def ask_model(batches: DataFrame, model: Model, text: str = "content") -> DataFrame:
    """``batches`` with the model's ``reply`` and, where it failed, ``error``. The model goes to every task."""
    schema = StructType([*batches.schema.fields, StructField("reply", StringType()), StructField("error", StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies, errors = [], []
            for content in frame[text]:
                try:
                    replies.append(model.generate(TASK + (content or "")[:PROMPT_CHARS]))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one failed call must not end the run
                    replies.append(None)
                    errors.append(str(e))
            yield frame.assign(reply=replies, error=errors)

    return batches.mapInPandas(run, schema)


def prompt_hash(text: Column, model: Model) -> Column:
    """The key of a reply: what the model is asked, and the model's name where it has one."""
    name = str(getattr(model, "model", type(model).__name__))
    return F.sha2(F.concat(F.lit(f"{name}\u0001{TASK}"), F.substring(F.coalesce(text, F.lit("")), 1, PROMPT_CHARS)), 256)


def ask_once(batches: DataFrame, model: Model, folder: str, text: str = "content") -> DataFrame:
    """``batches`` with ``reply`` and ``error``, asking only what the table of replies in ``folder`` does not answer.

    Equal prompts are asked once. Replies are appended to the table before anything is derived from them, so
    a plan that runs again reads them. A failed call leaves no reply, and is asked again the next time.
    """
    spark = batches.sparkSession
    keyed = batches.withColumn("prompt", prompt_hash(F.col(text), model))
    try:
        known = spark.read.parquet(folder).select("prompt", "reply").dropDuplicates(["prompt"])
    except AnalysisException:  # no reply yet
        known = spark.createDataFrame([], "prompt string, reply string")
    open_ = keyed.join(known.select("prompt"), "prompt", "left_anti").groupBy("prompt").agg(F.first(text).alias(text))
    told = stored(ask_model(open_, model, text))
    told.where("error is null").select("prompt", "reply").write.mode("append").parquet(folder)
    every = known.withColumn("error", F.lit(None).cast("string")).unionByName(told.select("prompt", "reply", "error"))
    return stored(keyed.join(every, "prompt", "left").drop("prompt"))


def narrow_provenance(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` with ``source_chunks``: of the chunks of its batch only those that name the concept, in order."""
    listed = found.select("source_file", "batch", "rank", "name", F.posexplode("chunk_ids").alias("i", "chunk_id"))
    named = listed.join(chunks.select("chunk_id", F.col("content").alias("chunk")), "chunk_id").where(is_grounded(F.col("name"), F.col("chunk")))
    kept = named.groupBy("source_file", "batch", "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "chunk_id"))), lambda s: s["chunk_id"]).alias("source_chunks"))
    return found.join(kept, ["source_file", "batch", "rank"], "left").withColumn("source_chunks", F.coalesce("source_chunks", F.array().cast("array<string>")))


def _by_rule(batches: DataFrame) -> DataFrame:
    """What the rule-based stand-in for a model finds: rows like those of ``parse_reply``."""
    found = extract_by_rule(batches, ["source_file", "batch", "chunk_ids", "content"])
    text = F.concat(F.col("definition"), F.lit("\n\n[[tags:mock]]"))
    return found.select("source_file", "batch", "chunk_ids", "content", "rank", "name", text.alias("raw_content"), F.lit(RULE_CONFIDENCE).alias("confidence"))


def extract_concepts(batches: DataFrame, chunks: DataFrame, model: Model | None = None, replies: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw concepts, counters) of batches (source_file, batch, chunk_ids, content); without a model, by rule.

    A concept whose name is not in its batch's text is rejected; of names of a file that agree but for case
    the first stays (by batch, rank), with the chunks that name it. Every file that names a concept has its row; they
    meet when raw concepts are merged by slug, so that each of them is a source. A model is asked once for
    each prompt: its replies are stored, in ``replies`` also for later runs.
    """
    keys = ["source_file", "batch"]
    if model is None:
        found, failed = _by_rule(batches), batches.select(*keys).limit(0)
    else:
        asked = ask_once(batches, model, replies) if replies else stored(ask_model(batches, model))
        failed = asked.where(F.col("error").isNotNull() | json_object(F.col("reply")).isNull()).select(*keys)
        found = parse_reply(asked, [*keys, "chunk_ids", "content"])
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("name", "raw_content")) - 1)
    seen = found.withColumn("grounded", is_grounded(F.col("name"), F.substring("content", 1, PROMPT_CHARS)))
    good = narrow_provenance(seen.where("grounded").drop("grounded"), chunks)
    first = F.row_number().over(Window.partitionBy("source_file", F.lower("name")).orderBy("batch", "rank"))
    raw = good.withColumn("first", first).where("first = 1")
    raw = raw.select("source_file", "batch", "rank", "name", "raw_content", "source_chunks", F.array("source_file").alias("source_files"), F.lit("llm").alias("extraction_method"), "confidence")
    sizes = batches.agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).alias("chunks_processed"))
    told = seen.agg(F.count_if("grounded").alias("concepts_extracted"), F.count_if(~F.col("grounded")).alias("rejected_by_grounding"))
    counters = sizes.join(F.broadcast(told)).join(F.broadcast(failed.agg(F.count("*").alias("parse_failures"))))  # one row each
    return raw, counters.select("chunks_processed", "calls", "concepts_extracted", "parse_failures", "rejected_by_grounding")


def distill(raw: DataFrame, by_rule: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Raw concepts distilled as their extraction method asks: marked contents of a model, or ``by_rule`` for others."""
    marked = distill_marked(raw.where("extraction_method = 'llm'"))
    others = by_rule(raw.where("extraction_method is null or extraction_method <> 'llm'"))
    return marked.unionByName(others, allowMissingColumns=True)
