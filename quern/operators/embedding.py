"""Embedding texts: model registry, prefixes, batches, normalisation and truncation around any backend.

A backend is a function from a list of texts to a matrix. It is built once in each Python worker
and called on Arrow batches; the default backend needs no model and hashes TF-IDF terms.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Backend = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class EmbeddingModel:
    """A model's facts: dimensions, most tokens, who serves it, prefixes and whether it can be truncated."""

    name: str
    dimensions: int
    max_tokens: int
    provider: str = "local"
    query_prefix: str = ""
    document_prefix: str = ""
    truncatable: bool = False
    batch_size: int = 32

    def fits(self, chunk_tokens: int) -> bool:
        return chunk_tokens <= self.max_tokens

    def shortened(self, dimensions: int) -> EmbeddingModel:
        """The model with only its first dimensions kept."""
        if not self.truncatable or not 0 < dimensions <= self.dimensions:
            raise ValueError(f"{self.name} cannot be cut to {dimensions} dimensions")
        return replace(self, dimensions=dimensions)


MODELS = {
    m.name: m
    for m in (
        EmbeddingModel("hashed-tfidf", 768, 1 << 30),
        EmbeddingModel("nomic-embed-text", 768, 8192, "http", "search_query: ", "search_document: ", True),
        EmbeddingModel("all-MiniLM-L6-v2", 384, 256),
        EmbeddingModel("mxbai-embed-large", 1024, 512, "http", "Represent this sentence for searching relevant passages: "),
    )
}


def hashed_terms(dimensions: int = 768, idf: dict[str, float] | None = None) -> Backend:
    """Term counts times idf (1 if unknown) in hashed buckets."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimensions))
        for row, text in zip(out, texts, strict=True):
            for term, n in Counter(re.findall("[a-z0-9]+", text.lower())).items():
                row[zlib.crc32(term.encode()) % dimensions] += n * (idf or {}).get(term, 1.0)
        return out

    return embed


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(size == 0, 1, size)


def prepare(vectors: np.ndarray, model: EmbeddingModel, normalize: bool = True) -> np.ndarray:
    """Truncate to the model's dimensions, then bring to unit length."""
    vectors = np.asarray(vectors, float)
    if vectors.shape[1] < model.dimensions:
        raise ValueError(f"the backend gave {vectors.shape[1]} dimensions, {model.name} has {model.dimensions}")
    cut = vectors[:, : model.dimensions]
    return unit(cut) if normalize else cut


def embed(rows: DataFrame, model: EmbeddingModel, make: Callable[[], Backend] | None = None, text_col: str = "text", query: bool = False, normalize: bool = True, out_col: str = "embedding") -> DataFrame:
    """The rows with an embedding column; a null text is embedded as empty.

    ``make`` builds the backend in the worker, so a model is loaded once for all its batches.
    """
    prefix = model.query_prefix if query else model.document_prefix
    build = make or (lambda: hashed_terms(model.dimensions))
    kept = [c for c in rows.columns if c != out_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out_col) + f", `{out_col}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = None
        for batch in batches:
            backend = backend or build()
            texts = [prefix + (t or "") for t in batch.column(text_col).to_pylist()]
            parts = [prepare(backend(texts[k : k + model.batch_size]), model, normalize) for k in range(0, len(texts), model.batch_size)]
            flat = np.concatenate([np.zeros((0, model.dimensions)), *parts]).astype(np.float32)
            offsets = np.arange(0, flat.size + 1, model.dimensions, dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], [*kept, out_col])

    return rows.select(*kept).mapInArrow(run, schema)


def fits(chunks: DataFrame, model: EmbeddingModel, tokens_col: str = "token_count") -> DataFrame:
    """Chunks with whether the model can take them whole."""
    return chunks.withColumn("fits", F.col(tokens_col) <= model.max_tokens)
