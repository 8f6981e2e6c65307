"""Vectors: hash embedding, cosine, dot product, mean direction."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import lean, small_batches
from .text import search_tokens

_PRIME, _BASIS, _MASK = 16_777_619, 2_166_136_261, 0xFFFFFFFF


def fnv1a(s: str) -> int:
    """FNV-1a, 32 bits, over UTF-16 code units."""
    h = _BASIS
    data = s.encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * _PRIME) & _MASK
    return h


@functools.lru_cache(maxsize=200_000)
def _hashes(token: str) -> tuple[int, float]:
    """The token's hash and its signed weight."""
    sign = 1.0 if fnv1a("sign:" + token) % 2 == 0 else -1.0
    return fnv1a(token), sign * (1 + math.log(len(token)))


def hash_embedding(text: str, dimensions: int = 128) -> list[float]:
    """Signed feature hashing of the search tokens, unit length, six decimals."""
    v = [0.0] * dimensions
    for t in search_tokens(text):
        h, weight = _hashes(t)
        v[h % dimensions] += weight
    norm = math.sqrt(sum(x * x for x in v))
    return [round(x / norm, 6) + 0.0 if norm else 0.0 for x in v]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a vector is zero or missing."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def bounded_dot(a: Column, b: Column) -> Column:
    """The dot product, kept within -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


class EmbeddingError(Exception):
    """code: one of unsupported_provider, invalid_options, unavailable, timeout, http_error, invalid_response, dimension_mismatch, non_finite, empty_vector."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


Embedder = Callable[[list[str]], list[list[float]]]
_PROVIDERS: dict[str, Callable[[str, int], Embedder]] = {}


def register_provider(name: str, factory: Callable[[str, int], Embedder]) -> None:
    """``factory(model, dimensions)`` gives a function from texts to vectors."""
    _PROVIDERS[name] = factory


def known_providers() -> frozenset[str]:
    return frozenset(_PROVIDERS)


def provider(name: str, model: str, dimensions: int) -> Embedder:
    if name not in _PROVIDERS:
        raise EmbeddingError("unsupported_provider", f"no embedding provider named {name}")
    embed = _PROVIDERS[name](model, dimensions)

    def checked(texts: list[str]) -> list[list[float]]:
        out = embed(texts)
        if len(out) != len(texts):
            raise EmbeddingError("invalid_response", "a vector for each text was expected")
        for v in out:
            if len(v) != dimensions:
                raise EmbeddingError("dimension_mismatch", f"{len(v)} dimensions instead of {dimensions}")
            if not all(math.isfinite(x) for x in v):
                raise EmbeddingError("non_finite", "a vector holds a number that isn't finite")
        return out

    return checked


register_provider("local-hash", lambda model, dimensions: lambda texts: [hash_embedding(t, dimensions) for t in texts])


def embed_column(c: Column, name: str, model: str, dimensions: int, batch: int = 16) -> Column:
    embed = provider(name, model, dimensions)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [t or "" for t in texts]
            out = [np.array(v, np.float32) for i in range(0, len(values), batch) for v in embed(values[i : i + batch])]
            yield pd.Series(out, dtype=object)

    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)  # texts are long
    return F.pandas_udf(lean(run), "array<float>")(c)
