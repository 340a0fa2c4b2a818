"""A stand-in for embedding models: signed hashes of words and their neighbours, of length 1. A model's Arrow function takes its place."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hashing_vector(text: str | None, dims: int) -> list[float]:
    out = np.zeros(dims)
    words = re.findall(r"\w+", (text or "").lower())
    for gram in [*words, *(" ".join(p) for p in zip(words, words[1:]))]:
        h = crc32(gram.encode())
        out[h % dims] += 1 if h >> 31 else -1
    n = np.linalg.norm(out)
    return (out / n if n else out).astype(np.float32).tolist()


def embedder(dims: int = 64, model: Callable[[list[str]], list[list[float]]] | None = None, batch: int = 32) -> Callable[[Column], Column]:
    """Function of a text column. model: from a list of texts to their vectors, called with batches."""

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            if model is None:
                yield texts.map(lambda t: hashing_vector(t, dims))
            else:
                values = texts.fillna("").tolist()
                yield pd.Series([v for i in range(0, len(values), batch) for v in model(values[i : i + batch])])

    return embed
