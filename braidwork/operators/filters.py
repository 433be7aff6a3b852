"""Filters, slices and few-shot choice over documents with a stable input order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_type(df: DataFrame, types: str | Iterable[str], column: str = "type") -> DataFrame:
    """FLT1: 'all', one type or several."""
    wanted = [types] if isinstance(types, str) else list(types)
    return df if wanted == ["all"] else df.where(F.col(column).isin(wanted))


def skip_limit(df: DataFrame, order: list[Column], skip: int = 0, limit: int | None = None) -> DataFrame:
    """FLT2: rows skip+1 .. skip+limit in the order given; with a limit, a top-k that keeps only skip+limit rows per task."""
    out = df.orderBy(*order)
    if limit is not None:
        return out.offset(skip).limit(limit) if skip else out.limit(limit)
    return out.offset(skip) if skip else df


def without_labels(df: DataFrame, labels: Iterable[str], column: str = "rel") -> DataFrame:
    """FLT3: rows whose label is none of those named; a null label stays."""
    labels = list(labels)
    return df.where(F.col(column).isNull() | ~F.col(column).isin(labels)) if labels else df


def with_labels(df: DataFrame, labels: Iterable[str] | None, column: str = "rel") -> DataFrame:
    """FLT7: rows of the relations named; all of them if none is."""
    labels = list(labels or [])
    return df.where(F.col(column).isin(labels)) if labels else df


def well_formed(pair: Column) -> Column:
    """FLT4: a pair of exactly two strings."""
    return (F.size(pair) == 2) & F.get(pair, F.lit(0)).isNotNull() & F.get(pair, F.lit(1)).isNotNull()


def prediction_view(df: DataFrame, mode: str = "pred-only") -> DataFrame:
    """FLT5: (document_id, pred_relations), or the whole documents."""
    if mode not in ("pred-only", "full"):
        raise ValueError(f"unknown mode {mode!r}")
    return df.select("document_id", "pred_relations") if mode == "pred-only" else df


def primitive_columns(df: DataFrame) -> DataFrame:
    """FLT6: the columns of strings, numbers and booleans."""
    return df.select(*(c for c, kind in df.dtypes if kind in ("string", "boolean", "int", "bigint", "double", "float", "smallint", "tinyint")))


def named(df: DataFrame, **wanted: str | None) -> DataFrame:
    """FLT8: each keyword is a column and a comma-separated list of values, compared without case; None or empty: any."""
    for column, text in wanted.items():
        values = [v.strip().lower() for v in (text or "").split(",") if v.strip()]
        if values:
            df = df.where(F.lower(column).isin(values))
    return df


def has_relations(relations: str = "relations") -> Column:
    """Whether a document has a relation with at least one pair."""
    return F.coalesce(F.exists(F.map_values(relations), lambda p: F.coalesce(F.size(p) > 0, F.lit(False))), F.lit(False))


def few_shots(df: DataFrame, n: int, order: list[Column], types: str | Iterable[str] = "train", skip: int = 0, pool: int | None = None, pool_first: bool = True) -> DataFrame:
    """FLT9: the first n documents with relations.  pool_first: the pool is cut from all documents of the type, then those without
    relations go; else the pool is cut from documents with relations."""
    df = of_type(df, types)
    if pool_first:
        return skip_limit(skip_limit(df, order, skip, pool).where(has_relations()), order, 0, n)
    return skip_limit(skip_limit(df.where(has_relations()), order, skip, pool), order, 0, n)


def last_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """WIN10: of the rows of one key the last in the order given; rows with a null key go.  One shuffle by key, window group limit."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.where(F.col(key).isNotNull()).withColumn("_last", F.row_number().over(w)).where("_last = 1").drop("_last")


def latest(documents: DataFrame) -> DataFrame:
    """The latest delivery of each document (document_id, ingested_at, row_id)."""
    return last_wins(documents, "document_id", F.col("ingested_at").desc_nulls_last(), F.col("row_id").desc())


def top(df: DataFrame, group: list[str], order: list[Column], k: int | None, rank: str = "rank") -> DataFrame:
    """Rows of each group ranked in the total order given, the first k of them; FLT10 filters stand before it."""
    out = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if k is None else out.where(F.col(rank) <= k)
