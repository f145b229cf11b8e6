"""Embedding providers and batch embedding of sections."""

from __future__ import annotations

import contextlib
import os
import zlib
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import embedding_text, model_input

BATCH = 32


class EmbeddingProvider(Protocol):
    """What a model has to offer; instances are sent to the executors."""

    model: str
    dims: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashingProvider:
    """Unit vectors from hashed words; needs no model file and is the same everywhere."""

    def __init__(self, dims: int = 64):
        self.model, self.dims = f"hashing-{dims}", dims

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.dims] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()

    def embed_query(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]


class NoProvider:
    """Stands in where no model can be loaded; embeds nothing."""

    model, dims = "none", 0

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        raise RuntimeError("no embedding model is available")


def latest_jobs(jobs: DataFrame, position: str = "position") -> DataFrame:
    """One job per section: the last one queued."""
    order = Window.partitionBy("section_id").orderBy(F.desc(position))
    return jobs.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r")


class EmbeddingEvents:
    """Listeners to what an embedding run reports; their errors are ignored."""

    def __init__(self) -> None:
        self.listeners: list[Callable[[str, dict], None]] = []

    def on(self, listener: Callable[[str, dict], None]) -> None:
        self.listeners.append(listener)

    def off(self, listener: Callable[[str, dict], None]) -> None:
        self.listeners = [x for x in self.listeners if x is not listener]

    def emit(self, event: str, **data) -> None:
        for listener in self.listeners:
            with contextlib.suppress(Exception):
                listener(event, data)

    def report(self, results: DataFrame) -> None:
        """empty, or progress, an error with the number of failed texts if there are any, and complete."""
        found = results.agg(F.count("*").alias("n"), F.count("error").alias("failed")).first()
        if not found.n:
            self.emit("empty")
            return
        self.emit("progress", completed=found.n - found.failed, total=found.n)
        if found.failed:
            self.emit("error", failed=found.failed)
        self.emit("complete", completed=found.n - found.failed, total=found.n)


def expand_tilde(path: str) -> str:
    return os.path.expanduser(path) if path == "~" or path.startswith("~/") else path


def is_model_cached(folder: str, model: str) -> bool:
    """Whether the model's folder is there and holds anything."""
    where = os.path.join(expand_tilde(folder), *model.split("/"))
    return os.path.isdir(where) and bool(os.listdir(where))


def cache_size(folder: str) -> int:
    """Bytes of all files below a folder; 0 where there is none."""
    return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(expand_tilde(folder)) for n in names)


def embed(sections: DataFrame, provider: EmbeddingProvider, batch: int = BATCH) -> DataFrame:
    """(section_id, embedding, error) of all rows.

    Texts go to the model in small batches; if one fails, its texts are tried
    one by one, and a text that fails alone has its error and no vector.
    """
    text = model_input(embedding_text(F.col("heading"), F.col("content")), provider.model, False)

    def work(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                texts = part["text"].tolist()
                errors: list[str | None] = [None] * len(texts)
                try:
                    vectors = list(provider.embed_batch(texts))
                except Exception:  # noqa: BLE001  one text may spoil its batch
                    vectors = []
                    for i, t in enumerate(texts):
                        try:
                            vectors.append(provider.embed_batch([t])[0])
                        except Exception as e:  # noqa: BLE001
                            vectors.append(None)
                            errors[i] = str(e)
                yield pd.DataFrame({"section_id": part["section_id"].tolist(), "embedding": vectors, "error": errors})

    return sections.select("section_id", text.alias("text")).mapInPandas(work, "section_id long, embedding array<float>, error string")
