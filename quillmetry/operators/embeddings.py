"""Vectors of texts: a hook for any model that takes batches, and hashed word vectors as the model-free default.

Defined results: null texts have no vector (null), texts without words the zero vector. Texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W\d_]+")

Model = Callable[[list[str]], np.ndarray]


def embed(texts: DataFrame, text: str, load: Callable[[], Model], dim: int, to: str = "embedding", batch: int = 64) -> DataFrame:
    """Add 32-bit vectors of `load()`'s model. The model is loaded once per task and fed `batch` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            values = b.column(text).to_pylist()
            held = [i for i, v in enumerate(values) if v is not None]
            out: list = [None] * len(values)
            for lo in range(0, len(held), batch):
                part = held[lo : lo + batch]
                got = np.asarray(model([values[i] for i in part]), np.float32)
                if got.shape != (len(part), dim):
                    raise ValueError(f"the model gave {got.shape}, not {(len(part), dim)}")
                for i, v in zip(part, got):
                    out[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, to])

    return texts.mapInArrow(run, texts.withColumn(to, F.lit(None).cast("array<float>")).schema)


def hashing_model(dim: int) -> Model:
    """Counts of words by hash bucket, of length 1, for a batch of texts: what `embed` uses where there is no other model."""

    def run(values: list[str]) -> np.ndarray:
        out = np.zeros((len(values), dim))
        for i, v in enumerate(values):
            words = _WORD.findall(v.lower())
            if words:
                np.add.at(out[i], [zlib.crc32(w.encode("utf-8", "surrogatepass")) % dim for w in words], 1.0)
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(size == 0, 1.0, size)

    return run


def hashed(texts: DataFrame, text: str, dim: int = 64, to: str = "embedding") -> DataFrame:
    return embed(texts, text, lambda: hashing_model(dim), dim, to)
