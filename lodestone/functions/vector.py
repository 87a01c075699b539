"""Vector expressions in double precision, and an encoder that needs no model."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is missing or has no length."""
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def unit(v: Column) -> Column:
    """The vector over its norm, worked out once a row; one without length stays as it is."""
    norm = F.array(F.sqrt(dot(v, v)))
    return F.get(F.transform(norm, lambda n: F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))), F.lit(0))


def hybrid(v: Column, query: Column, words: Column, held: Column, weight: float = 0.05) -> Column:
    """Cosine and a small part for the share of the query's words that are there."""
    from .text import overlap

    return cosine(v, query) + F.lit(weight) * overlap(words, held)


def hashing_encoder(dims: int = 64):
    """A deterministic stand-in for a sentence model: signed counts of hashed words, scaled to length one."""

    @F.pandas_udf("array<float>")
    def encode(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[float]:
            v = [0.0] * dims
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % dims] += 1.0 if h & 1 << 31 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            return [x / n for x in v]

        return texts.map(one)

    return encode
