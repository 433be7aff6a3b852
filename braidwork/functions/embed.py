"""The hashing embedder, as a JVM expression and as numpy over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.text import words


def bucket(token: Column, dim: int = 256) -> Column:
    """md5 of a token modulo dim: hex digits folded in limbs of 16 bits; a power of two up to 65536 needs the last limb only."""
    digest = F.md5(token)
    if dim <= 65536 and dim & (dim - 1) == 0:
        return F.conv(F.substring(digest, 29, 4), 16, 10).cast("int") % dim
    limbs = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    return F.aggregate(limbs, F.lit(0).cast("bigint"), lambda a, x: (a * 65536 + x) % dim).cast("int")


def sparse(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """RET1: (key, bucket, weight) of the unit vector of each text, only its non-zero buckets; a text without words has none."""
    counts = df.select(key, F.explode(words(text)).alias("t")).groupBy(key, bucket(F.col("t"), dim).alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(key, "bucket", (F.col("n") / F.col("norm")).alias("weight"))


class Hasher:
    """Texts to a matrix of unit vectors, a word's md5 being computed once per task."""

    def __init__(self, dim: int = 256):
        self.dim, self.memo = dim, {}

    def _bucket(self, word: str) -> int:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[word] = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest(), 16) % self.dim
        return got

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each bucket has a word of each text."""
        lists = [(t or "").lower().split() for t in texts]
        flat = np.fromiter((self._bucket(w) for ws in lists for w in ws), np.int64)
        row = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])
        return np.bincount(row * self.dim + flat, minlength=len(lists) * self.dim).reshape(len(lists), self.dim)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return unit(self.counts(texts))


def unit(counts: np.ndarray) -> np.ndarray:
    """Unit vectors of counts; zero vectors stay."""
    out = counts.astype(np.float64)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1.0)


Loader = Callable[[], Callable[[list], object]]


def embed(df: DataFrame, text: str, out: str = "vector", dim: int = 256, make: Loader | None = None) -> DataFrame:
    """A column with each text's vector, by Arrow batches.  RET2: make is a model's loader: a function without arguments that gives one from a
    list of texts to a matrix; it is called once in a task, before the first batch."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Hasher(dim) if make is None else make()
        for s in batches:
            yield pd.Series([np.asarray(v, np.float64) for v in model(s.tolist())], dtype=object)

    return df.withColumn(out, vectors(F.col(text)))


def pair_score(query: str, text: str, make: Loader) -> Column:
    """WIN9: the scores that a model gives to pairs of query and text; make loads it, once in a task, and it takes a list of pairs."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series(np.asarray(model(list(zip(q.tolist(), t.tolist(), strict=True))), np.float64))

    return score(F.col(query), F.col(text))


def cosine(a: Column, b: Column) -> Column:
    """RET11: 0 if a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))
