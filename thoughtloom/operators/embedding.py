"""Vectors of concepts from an embedding server: the interface, two forms of HTTP, and the table of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extraction import http_post
from .retrieval import embedding_text


class Embedder(Protocol):
    """What turns texts into vectors of one width."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass
class HttpEmbedder:
    """A server in the "ollama" form (a text a call) or the "openai" form (many texts a call)."""

    url: str
    model: str
    form: str = "ollama"
    key: str = ""
    timeout: float = 60.0
    post: Callable[[str, dict, dict, float], dict] = field(default=http_post, repr=False)

    def embed(self, texts: list[str]) -> list[list[float]]:
        base, headers = self.url.rstrip("/"), {"Authorization": f"Bearer {self.key}"} if self.key else {}
        if self.form == "ollama":
            return [list(self.post(f"{base}/api/embeddings", {"model": self.model, "prompt": t}, headers, self.timeout).get("embedding", [])) for t in texts]
        told = self.post(f"{base}/embeddings", {"model": self.model, "input": texts}, headers, self.timeout)
        return [list(item.get("embedding", [])) for item in told.get("data", [])]


@dataclass
class CannedEmbedder:
    """Vectors by a function of the text; for tests."""

    of: Callable[[str], list[float]]

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.of(t) for t in texts]


def embed_concepts(concepts: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """(slug, vector) of each concept, asked for in batches by the tasks; without an answer there is no row."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                rows = [(s, [float(x) for x in v]) for s, v in zip(part["slug"], embedder.embed(list(part["text"]))) if v]
                yield pd.DataFrame(rows, columns=["slug", "vector"])

    return concepts.select("slug", embedding_text(concepts).alias("text")).mapInPandas(run, "slug string, vector array<double>")
