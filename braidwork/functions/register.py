"""Names for SQL: Python functions of the package in a session's catalogue."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.answers import first_json_text
from braidwork.functions.embed import Hasher

Embedder = Callable[[list[str]], object]


def register(spark: SparkSession, embedder: Embedder | None = None) -> list[str]:
    """first_json(text), hash_embed(text) and, of another embedder from texts to a matrix, embed(text); the names registered."""

    @F.pandas_udf(T.StringType())
    def first_json(s: pd.Series) -> pd.Series:
        return s.map(first_json_text)

    def vectors(embed: Embedder):
        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def udf(s: pd.Series) -> pd.Series:
            return pd.Series(list(embed(s.tolist())))

        return udf

    found = {"first_json": first_json, "hash_embed": vectors(Hasher())} | ({"embed": vectors(embedder)} if embedder else {})
    for name, f in found.items():
        spark.udf.register(name, f)
    return list(found)
