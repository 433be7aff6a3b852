"""Ranked retrieval for a batch of queries: vector search, fusion, lexical overlap. Every ranking has a total order."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions import text as txt
from braidwork.functions.embed import Hasher, unit
from braidwork.operators.filters import top
from braidwork.session import stage

#: Words of queries up to this number are broadcast to the edges.
HELD = 500_000
#: Queries that tasks hold at once; more are answered in several passes over the index.
QUERIES = 5000
#: Queries and items whose scores nearest_held() makes at once.
ROWS, BLOCK = 512, 4096
SCORES = {"dot": lambda m, q: m @ q.T, "cosine": lambda m, q: _unit(m) @ _unit(q).T, "l2_inverse": lambda m, q: 1.0 / (1.0 + _distance(m, q))}


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm > 0, norm, 1.0)


def _distance(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((m * m).sum(1)[:, None] - 2 * m @ q.T + (q * q).sum(1)[None, :], 0.0))


def _matrix(column: pa.Array, hasher: Hasher | None) -> np.ndarray:
    if hasher is not None:
        return hasher(column.to_pylist())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(queries: DataFrame, index: DataFrame, query_id: str, item_id: str, value: str, k: int = 5, score: str = "dot", dim: int | None = 256, digits: int = 9, least: float | None = None) -> DataFrame:
    """RET3-6, WIN1: (query_id, item_id, score, rank) of the k items of best score for each query, ties by item.

    value is a text column on both sides, hashed to dim buckets, or with dim None a column of vectors.  Queries are broadcast, QUERIES
    at a time; each batch of items is one matrix product, and only the k best per query of all its batches leave a task, so the shuffle
    carries k rows per query and task.  score: dot, cosine or l2_inverse; scores are rounded before they are compared; least drops
    lower scores first (FLT10).  Null values have no row as queries and never are items (of vectors; a null text has a zero vector).
    """
    spark = index.sparkSession
    asked = queries.select(query_id, value).where(F.col(value).isNotNull()) if dim is None else queries.select(query_id, value)
    passes = max(1, -(-asked.count() // QUERIES))
    items = index.select(item_id, value)
    if dim is None:
        items = items.where(F.col(value).isNotNull())
    out = None
    schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(item_id, index.schema[item_id].dataType), T.StructField("score", T.DoubleType())])
    for p in range(passes):
        chunk = asked.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p).toPandas() if passes > 1 else asked.toPandas()
        if not len(chunk):
            continue
        ids = pa.array(chunk[query_id])
        given = Hasher(dim)(chunk[value].tolist()) if dim is not None else np.array([np.asarray(v, np.float64) for v in chunk[value]])
        held = spark.sparkContext.broadcast((ids, given))
        one = items.mapInArrow(_best(held, item_id, value, k, score, dim, digits, least, schema.fieldNames()), schema)
        out = one if out is None else out.unionAll(one)
    if out is None:
        out = spark.createDataFrame([], schema)
    return top(out, [query_id], [F.desc("score"), F.col(item_id)], k)


def _best(held, item_id, value, k, score, dim, digits, least, names):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim) if dim is not None else None
        ids, given = held.value
        kept: list[pa.Table] = []  # (query, score, item): the k best of each query so far, and more of late

        def trimmed() -> pa.Table:
            both = pa.concat_tables(kept)
            both = both.take(pa.compute.sort_indices(both, sort_keys=[("q", "ascending"), ("s", "descending"), ("i", "ascending")]))
            q = both.column("q").to_numpy()
            first = np.searchsorted(q, q)
            return both.filter(pa.array(np.arange(len(q)) - first < k))

        for b in batches:
            if not b.num_rows:
                continue
            order = pa.compute.sort_indices(b.column(item_id))
            b = b.take(order)
            s = np.round(SCORES[score](_matrix(b.column(value), hasher), given), digits).T + 0.0
            n = min(k, s.shape[1])
            bar = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
            over, even = s > bar, s == bar
            even &= np.cumsum(even, 1) <= n - over.sum(1, keepdims=True)  # of equal scores the smaller items
            rows, cols = np.nonzero(over | even)
            if least is not None:
                good = s[rows, cols] >= least
                rows, cols = rows[good], cols[good]
            kept.append(pa.table({"q": pa.array(rows), "s": pa.array(s[rows, cols]), "i": b.column(item_id).take(pa.array(cols))}))
            if len(kept) > 4:
                kept = [trimmed()]
        if kept:
            done = trimmed().combine_chunks()
            for c in done.to_batches():
                yield pa.RecordBatch.from_arrays([ids.take(c.column("q")), c.column("i"), c.column("s")], names=names)

    return best


def nearest_held(queries: DataFrame, items: DataFrame, keys: list[str], text: str, item_id: str, item_text: str, k: int = 5, least: float | None = None, dim: int = 256, digits: int = 9, held: int = 200_000) -> DataFrame:
    """(keys..., item_id, score, rank): for each of any number of queries the k items of best cosine of hashed vectors, ties by item.

    The other way round than nearest(): tasks hold the items, `held` of them at a time as small counts of words by bucket, and queries stream past
    them and are never shuffled; with more items the k best of each pass are ranked together.  Scores are made for ROWS queries and BLOCK items at a
    time, so a task's memory follows neither table."""
    spark = queries.sparkSession
    passes = max(1, -(-items.count() // held))
    schema = T.StructType([queries.schema[c] for c in keys] + [T.StructField(item_id, items.schema[item_id].dataType), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def best_of(shared):
        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(dim)
            ids, counts = shared.value
            for whole in batches:
                for b in (whole.slice(at, ROWS) for at in range(0, whole.num_rows if len(ids) else 0, ROWS)):
                    row, item, score, rank = _held_best(hasher(b.column(text).to_pylist()), counts, k, digits)
                    if least is not None:
                        row, item, score, rank = (x[score >= least] for x in (row, item, score, rank))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in keys), ids.take(pa.array(item)).cast(pa_type(schema[item_id])), pa.array(score), pa.array(rank)], names=schema.fieldNames())

        return best

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(dim)
        for whole in batches:
            for b in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                c = hasher.counts(b.column(1).to_pylist())
                small = c.astype(np.min_scalar_type(int(c.max(initial=0))))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in small], pa.binary())], names=["id", "counts"])

    asked = queries.select(*keys, text)
    asked = stage(asked) if passes > 1 else asked
    out = None
    for p in range(passes):
        part = items.select(F.col(item_id).alias("id"), item_text)
        part = part.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else part
        rows = part.mapInArrow(counted, T.StructType([T.StructField("id", items.schema[item_id].dataType), T.StructField("counts", T.BinaryType())])).orderBy("id").toArrow()  # about `held`
        width = pa.compute.max(pa.compute.binary_length(rows.column("counts"))).as_py() // dim if rows.num_rows else 1
        counts = np.empty((rows.num_rows, dim), f"u{width}")
        for at, x in enumerate(v for c in rows.column("counts").chunks for v in c):
            x = x.as_buffer()
            counts[at] = np.frombuffer(x, f"u{len(x) // dim}")
        shared = spark.sparkContext.broadcast((rows.column("id").combine_chunks(), counts))
        one = asked.mapInArrow(best_of(shared), schema)
        out = one if out is None else out.unionAll(one)
    return out if passes == 1 else top(out.drop("rank"), keys, [F.desc("score"), F.col(item_id)], k)


def _held_best(q: np.ndarray, counts: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, ...]:
    """(row, item, score, rank) of the k items of best rounded cosine for each unit vector, ties in the order of items."""
    n = len(q)
    row, item, score, rank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    bar = np.full(n, -np.inf)  # the k-th best so far; a later item must exceed it
    at, size = 0, max(k, BLOCK // 8)
    while at < len(counts):
        s = q @ unit(counts[at : at + size]).T
        r, c = np.nonzero(s > (bar - 10.0**-digits)[:, None])
        v = np.round(s[r, c], digits)
        more = v > bar[r]
        row, item, score = (np.concatenate(x) for x in ((row, r[more]), (item, c[more] + at), (score, v[more])))
        order = np.lexsort((item, -score, row))
        row, item, score = row[order], item[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        row, item, score, rank = (x[rank <= k] for x in (row, item, score, rank))
        bar[row[rank == k]] = score[rank == k]
        at, size = at + size, BLOCK
    return row, item, score, rank.astype(np.int32)


def pa_type(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def rerank(ranked: DataFrame, scorer: Callable[[DataFrame], Column] | Column, group: list[str], k: int) -> DataFrame:
    """WIN9: a second score, then the k best; ties keep the first ranking."""
    score = scorer(ranked) if callable(scorer) else scorer
    return top(ranked.withColumn("rerank_score", score), group, [F.desc("rerank_score"), F.col("rank")], k, "new_rank")


def fuse(ranked: list[DataFrame], keys: list[str], query_id: str = "query_id", top_k: int = 5, k: int = 60, digits: int = 12) -> DataFrame:
    """RET7, WIN2: reciprocal rank fusion of rankings (query_id, keys..., rank from 1): (query_id, keys..., score, rank); an item that
    a ranking lists twice counts twice; ties by the ranking and rank in which an item was first seen."""
    if not ranked:
        raise ValueError("fusion needs at least one ranking")
    both = None
    for i, r in enumerate(ranked):
        one = r.select(query_id, *keys, F.lit(i).alias("_no"), F.col("rank").cast("int").alias("_rank"))
        both = one if both is None else both.unionAll(one)
    fused = both.groupBy(query_id, *keys).agg(F.round(F.sum(1.0 / (k + F.col("_rank"))), digits).alias("score"), F.min(F.struct("_no", "_rank")).alias("_first"))
    return top(fused, [query_id], [F.desc("score"), F.col("_first")], top_k).drop("_first")


def overlap(queries: DataFrame, edges: DataFrame, query_id: str = "query_id", query: str = "query", k: int = 10) -> DataFrame:
    """RET9, JN7, WIN3: (query_id, edge_id, score, rank, evidence, document_id): edges (edge_id, source, type, target and optionally
    source_label, target_label, document_id) by the number of distinct words they share with each query; only edges that share one,
    ties by edge_id.  A blank query finds nothing.  Words are joined; counts are added up before the ranking."""
    have = set(edges.columns)
    extra = [F.coalesce(F.col(c), F.lit("")) for c in ("source_label", "target_label") if c in have]
    rel = F.coalesce(F.col("type"), F.lit("RELATED"))
    words = txt.graph_tokens(F.concat_ws(" ", "source", rel, "target", *extra))
    left = queries.select(query_id, F.explode(txt.graph_tokens(query)).alias("w"))
    if left.limit(HELD + 1).count() <= HELD:
        left = F.broadcast(left)  # then no word, however many edges share it, is a key of a shuffle; else hot words are split by adaptive joins
    right = edges.select("edge_id", F.explode(words).alias("w"))
    hits = right.join(left, "w").groupBy(query_id, "edge_id").agg(F.count("*").cast("double").alias("score"))
    best = top(hits, [query_id], [F.desc("score"), F.col("edge_id")], k)
    doc = F.coalesce("document_id", "source") if "document_id" in have else F.col("source")
    shown = edges.select("edge_id", F.concat_ws("", "source", F.lit(" —"), rel, F.lit("→ "), "target").alias("evidence"), doc.alias("document_id"))
    return best.join(shown, "edge_id").select(query_id, "edge_id", "score", "rank", "evidence", "document_id")


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """AGG8: the mean vector of each group, scaled to unit length; zero if the mean is."""
    at = vectors.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = at.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x * x))
    return listed.select(group, F.transform("mean", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))).alias("centroid"))


def soft_match(spans: DataFrame, events: DataFrame, least: float | None = None) -> DataFrame:
    """RET22: for each span (doc_id, span_id, span_text[, neighbour_pos]) the best event (doc_id, event_id, event_text, event_tag,
    text) of its document: .45 word Jaccard + .45 sequence ratio + .10 containment, + .03 for ACTION_ tags, - .02 log1p of the
    distance to neighbour_pos; ties to the larger event_id.  The sequence ratio leaves the JVM only for events that it could still make the best."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    both = spans.join(events, "doc_id")
    la, lb = F.length(txt.soft_norm("span_text")), F.length(txt.soft_norm("event_text"))
    most = F.when(la + lb > 0, 2 * F.least(la, lb) / (la + lb)).otherwise(1.0)  # no sequence ratio is larger
    a, b = txt.soft_tokens("span_text"), txt.soft_tokens("event_text")
    score = 0.45 * txt.jaccard(F.array_distinct(a), F.array_distinct(b)) + 0.10 * txt.containment(F.array_join(a, " "), F.array_join(b, " "))
    score = score + F.when(F.col("event_tag").startswith("ACTION_"), 0.03).otherwise(0.0)
    if "neighbour_pos" in spans.columns:
        at = F.instr(txt.soft_norm("text"), txt.soft_norm("event_text")) - 1
        score = score - F.when(F.col("neighbour_pos").isNotNull() & (at >= 0), 0.02 * F.log1p(F.abs(F.col("neighbour_pos") - at))).otherwise(0.0)
    scored = both.withColumn("_low", score).withColumn("_most", F.max("_low").over(Window.partitionBy("doc_id", "span_id"))).where(F.col("_low") + 0.45 * most >= F.col("_most") - 1e-9)
    exact = scored.withColumn("score", F.col("_low") + 0.45 * ratio(txt.soft_norm("span_text"), txt.soft_norm("event_text")))
    ranked = top(exact, ["doc_id", "span_id"], [F.desc("score"), F.desc("event_id")], 1)
    return ranked.select("doc_id", "span_id", "event_id", "score") if least is None else ranked.where(F.col("score") >= least).select("doc_id", "span_id", "event_id", "score")


def best_by_jaccard(spans: DataFrame, events: DataFrame, least: float = 0.2) -> DataFrame:
    """RET23: the first event (doc_id, event_id, pos, event_text) of highest word Jaccard, at least `least`, for each span (doc_id,
    span_id, span_text)."""
    score = txt.jaccard(F.array_distinct(txt.words("span_text")), F.array_distinct(txt.words("event_text")))
    ranked = top(spans.join(events, "doc_id").withColumn("score", score).where(F.col("score") >= least), ["doc_id", "span_id"], [F.desc("score"), F.col("pos")], 1)
    return ranked.select("doc_id", "span_id", "event_id", "score")
