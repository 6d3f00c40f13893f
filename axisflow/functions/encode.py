"""Text encoders as columns: a deterministic hash embedding, and any batch encoder that is plugged in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hash_vector(text: str, dim: int) -> np.ndarray:
    """Elements between -1 and 1 from BLAKE2b blocks, scaled to length 1."""
    raw = b"".join(hashlib.blake2b(f"{i}:{text}".encode()).digest() for i in range(-(-dim // 64)))
    v = np.frombuffer(raw[:dim], np.uint8).astype(np.float64) / 127.5 - 1.0
    return v / max(float(np.linalg.norm(v)), 1e-12)


def with_hash_embedding(df: DataFrame, column: str, dim: int = 384, out: str = "embedding") -> DataFrame:
    return with_embedding(df, column, lambda: lambda texts: np.stack([hash_vector(t, dim) for t in texts]), out)


def with_embedding(df: DataFrame, column: str, load: Callable[[], Callable[[list[str]], np.ndarray]], out: str = "embedding") -> DataFrame:
    """`load` runs once a task and gives a function from texts to a matrix; null counts as ''."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = model(["" if t is None else t for t in texts]) if len(texts) else []
            yield pd.Series([[float(x) for x in r] for r in rows], dtype=object)

    return df.withColumn(out, encode(F.col(column)))
