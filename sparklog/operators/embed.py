"""Embedding of segment texts, each distinct text once per model and version."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.operators.bronze import hash_id
from sparklog.sources.config import SourceConfig
from sparklog.sources.tables import Store


class Embedder(Protocol):
    """Texts to unit vectors, pinned by name and version, so that vectors of two models never mix."""

    model: str
    version: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words and character trigrams: deterministic and lexical, not semantic."""

    model = "hashing-words-trigrams"

    def __init__(self, dim: int = 384):
        self.dim = dim
        self.version = f"1/{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float64)
        for i, text in enumerate(texts):
            low = text.lower()
            features = re.findall(r"\w+", low) + [low[j : j + 3] for j in range(len(low) - 2)]
            for f in features:
                h = zlib.crc32(f.encode())
                out[i, (h >> 1) % self.dim] += 1 if h & 1 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype(np.float32)


class SentenceTransformerEmbedder:
    """A sentence-transformers model, where that package is installed."""

    def __init__(self, name: str = "all-MiniLM-L6-v2", dim: int = 384):
        self.model, self.version, self.dim = name, f"sentence-transformers/{name}", dim
        self._loaded = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def encode(self, texts: list[str]) -> np.ndarray:
        if self._loaded is None:  # once per worker
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return np.asarray(self._loaded.encode(texts, normalize_embeddings=True), np.float32)


@dataclass
class EmbedResult:
    segments_embedded: int = 0
    segments_skipped_existing: int = 0

    def __str__(self) -> str:
        return f"Embedding run: {self.segments_embedded} embedded, {self.segments_skipped_existing} had a vector already"


def embed_texts(texts: DataFrame, embedder: Embedder, column: str = "segment_text") -> DataFrame:
    """Adds ``embedding`` to rows of texts, in Arrow batches; the embedder is unpickled once per worker."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder.encode(batch.fillna("").tolist())))

    return texts.withColumn("embedding", encode(column))


def embed_segments(store: Store, config: SourceConfig | None = None, embedder: Embedder | None = None) -> EmbedResult:
    """Vectors for the segments (of one source, or all) that have none of this model and version."""
    embedder = embedder or HashingEmbedder()
    source = config.source_id if config else None
    stored = store.read("gold_embeddings", source).filter((F.col("embedding_model") == embedder.model) & (F.col("embedding_version") == embedder.version))
    segments = store.read("gold_exception_segments", source).select("id", "source_id", "segment_text")
    waiting = segments.join(stored.select(F.col("segment_id").alias("id")), "id", "left_anti")
    result = EmbedResult(waiting.count())
    result.segments_skipped_existing = segments.count() - result.segments_embedded
    if result.segments_embedded:
        vectors = embed_texts(waiting.select("segment_text").distinct(), embedder)
        rows = waiting.join(vectors, "segment_text").select(F.col("id").alias("segment_id"), "source_id", "embedding")
        rows = rows.withColumn("embedding_model", F.lit(embedder.model)).withColumn("embedding_version", F.lit(embedder.version)).withColumn("created_at_utc", F.current_timestamp())
        rows = rows.withColumn("id", hash_id("segment_id", "embedding_model", "embedding_version"))
        store.append_new("gold_embeddings", rows, ["segment_id", "embedding_model", "embedding_version"], (), source)
    return result
