"""Embedders: callables from a list of texts to a list of vectors, with the vectors' length as ``dim``."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class ByteEmbedder:
    """For tests: byte i of a text adds its value plus one to component i modulo dim; the first component gets one more, so no vector is null."""

    def __init__(self, dim: int = 384):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            b = np.frombuffer(t.encode(), np.uint8)
            v = np.bincount(np.arange(len(b)) % self.dim, b + 1.0, self.dim)
            v[0] += 1
            out.append(v.astype(np.float32).tolist())
        return out


def embedded(rows: DataFrame, embedder: Embedder, text: str = "content", to: str = "embedding", chunk: int = 128) -> DataFrame:
    """``rows`` with the vectors of ``text``, made on the executors for ``chunk`` texts at a time; a null text has no vector."""
    kept = [c for c in rows.columns if c != to]
    at = kept.index(text)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), chunk):
                some = b.slice(lo, chunk)
                texts = some.column(at).to_pylist()
                made = iter(embedder([t for t in texts if t is not None]))
                vectors = pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*some.columns, vectors], [*kept, to])

    slim = rows.select(*kept)
    return slim.mapInArrow(part, T.StructType([*slim.schema, T.StructField(to, T.ArrayType(T.FloatType()))]))
