"""Reading level of each document, by a Rasch-style latent difficulty model.

Documents and words lie on one scale.  A document of level k and n distinct words holds a word w at the rate n * r, where

    log r(w, k) = c_w - (k - b_w)^2 / (2 s_w^2)

b_w is the word's difficulty and s_w its discrimination: only the difference of the two parameters counts, as in the unfolding form of the
Rasch model with Poisson counts.  Where the data call for no turning point the quadratic term is 0 and the word follows the plain Rasch form, a rate
that is log-linear in the level.  Levels are latent but for the documents that were rated, a rater erring by one now and then.

Estimation alternates: given the word parameters, each document's posterior of levels (a pass of the tasks); given the posteriors, each word's
parameters maximise its own concave Poisson likelihood, from five expected counts (Newton steps on the driver, on a table of fixed size).  Each
turn raises the penalised likelihood, which the tasks return with the counts; the rounds end when its gain is small.  Words are
hashed to BUCKETS parameters, so what tasks return and the model have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import sketch
from braidwork.llm.words import hashes, words
from braidwork.session import stage

BUCKETS = 1 << 16
LEVELS = np.arange(1, 6)
#: How a rating tells of a level: right, off by one, else.
RATER = (0.86, 0.06, 0.01)
#: Words of a text are not independent: their evidence counts by this power.  Pseudo-count of each word and level.  Least variance of a word.
POWER, PULL, LEAST = 0.5, 0.2, 0.1
_SCALE = 1 << 10  # sums are added as integers


@dataclass
class Model:
    """Log rates by word and level, their sums by level, and log shares of the levels; what lies behind them is (level, slope, curve)."""

    rates: np.ndarray  # (BUCKETS, levels), float32
    mass: np.ndarray
    shares: np.ndarray
    parameters: np.ndarray  # (BUCKETS, 3): log rate at the middle level, slope and half the curvature in the level

    def difficulty(self) -> np.ndarray:
        """b_w of the words that have a turning point, nan of those of plain Rasch form."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.parameters[:, 2] < 0, LEVELS.mean() - self.parameters[:, 1] / (2 * self.parameters[:, 2]), np.nan)

    def penalty(self) -> float:
        return float(PULL * POWER * self.rates.sum(dtype=np.float64) + 0.5 * self.shares.sum())


def _occurrences(least: int):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = [], []
            for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws = words(text)
                if len(ws) >= least:
                    ids.append(i)
                    lists.append(np.unique((hashes(ws) >> np.uint64(48)).astype(np.int32)))
            size = np.cumsum([0, *(len(x) for x in lists)]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(size), pa.array(flat, pa.int32()))], names=["id", "words"])

    return occurrences


def _entries(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the document of each, and words by document."""
    lists = b.column("words")
    size = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size), size


def _logs(b: pa.RecordBatch, rates: np.ndarray, mass: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """(documents, levels) the log of share times likelihood."""
    flat, row, size = _entries(b)
    said = np.stack([np.bincount(row, weights=rates[flat, k], minlength=len(size)) for k in range(len(LEVELS))], 1)
    return POWER * (said - size[:, None] * mass[None, :]) + shares[None, :]


def _normal(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _expected(model):
    """Tasks' sums over documents: expected counts by level and word, then in one block documents and words by level and the log-likelihood."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(LEVELS), BUCKETS))
        rest = np.zeros(sketch.BLOCK)
        for b in batches:
            rated = np.array([r if r is not None else [1.0] * len(LEVELS) for r in b.column("rated").to_pylist()]).reshape(-1, len(LEVELS))
            logs = np.log(np.maximum(rated, 1e-9))
            if model is not None:
                logs = logs + _logs(b, *model.value)
            post = _normal(logs) if len(logs) else logs
            flat, row, size = _entries(b)
            for k in range(len(LEVELS)):
                counts[k] += np.bincount(flat, weights=post[row, k], minlength=BUCKETS)
            n = len(LEVELS)
            rest[:n] += post.sum(0)
            rest[n : 2 * n] += (post * size[:, None]).sum(0)
            if len(logs):
                top = logs.max(1)
                rest[2 * n] += (top + np.log(np.exp(logs - top[:, None]).sum(1))).sum()
        rows = sketch.pack((np.concatenate([counts.ravel(), rest]) * _SCALE).round().astype(np.int64), TaskContext.get().partitionId())
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["block", "salt", "counts"])

    return expected


_X = np.stack([np.ones(len(LEVELS)), LEVELS - LEVELS.mean(), (LEVELS - LEVELS.mean()) ** 2.0], 1)


def _newton(counts: np.ndarray, exposure: np.ndarray, start: np.ndarray, free: int, steps: int = 12) -> np.ndarray:
    """Parameters (words, 3), the first `free` of them moved, that maximise sum_k counts log rate - exposure rate of each word; a step that
    would lower a word's likelihood is halved."""
    p, x = start.copy(), _X[:, :free]
    value = lambda q: (counts * (q @ _X.T)).sum(1) - (np.exp(np.minimum(q @ _X.T, 50)) * exposure).sum(1)
    now = value(p)
    for _ in range(steps):
        mean = np.exp(np.minimum(p @ _X.T, 50)) * exposure
        gradient = (counts - mean) @ x
        curve = np.einsum("wk,ki,kj->wij", mean, x, x) + 1e-9 * np.eye(free)
        move = np.linalg.solve(curve, gradient[:, :, None])[:, :, 0]
        scale = np.ones(len(p))
        for _ in range(12):
            q = p.copy()
            q[:, :free] += scale[:, None] * move
            then = value(q)
            worse = ~(then >= now)
            if not worse.any():
                break
            scale[worse] /= 2
        q[worse], then[worse] = p[worse], now[worse]
        done = np.abs(then - now).max(initial=0) < 1e-6
        p, now = q, then
        if done:
            break
    return p


def maximised(sums: np.ndarray, before: Model | None = None) -> tuple[Model, float]:
    """The model of most likelihood given the tasks' sums, and the penalised log-likelihood of the model that these were made with."""
    n = len(LEVELS)
    counts = sums[: n * BUCKETS].reshape(n, BUCKETS).T / _SCALE
    rest = sums[n * BUCKETS :] / _SCALE
    documents, exposure, logs = rest[:n], np.maximum(rest[n : 2 * n], 1e-3), rest[2 * n]
    shares = np.log((documents + 0.5) / (documents.sum() + 0.5 * n))
    seen = counts.sum(1) > 0.5 / _SCALE
    start = np.zeros((BUCKETS, 3))
    start[:, 0] = np.log((counts.sum(1) + n * PULL) / exposure.sum())
    if before is not None:
        start = before.parameters
    c = counts + PULL
    p = start.copy()
    p[~seen] = [np.log(n * PULL / exposure.sum()), 0, 0]
    own = np.flatnonzero(seen)
    fitted = _newton(c[own], exposure, start[own], 3)
    bound = np.clip(fitted[:, 2], -1 / (2 * LEAST), 0.0)
    out = np.flatnonzero(bound != fitted[:, 2])  # the likelihood is concave, so the best lies on the bound then
    fitted[out, 2] = bound[out]
    fitted[out] = _newton(c[own[out]], exposure, fitted[out], 2)
    p[own] = fitted
    rates = (p @ _X.T).astype(np.float32)
    model = Model(rates, np.exp(rates.astype(np.float64)).sum(0), shares, p)
    return model, logs + before.penalty() if before is not None else -np.inf


def estimate(table: DataFrame, most: int = 12, gain: float = 2e-4) -> tuple[Model, list[float]]:
    """The model of documents (words array<int>, rated array<double>, null if not rated), staged, and the penalised log-likelihood after each
    round.  The first model is that of the rated documents; the rounds end when one gains less than the share `gain`, or after `most`."""
    sc = table.sparkSession.sparkContext
    size = len(LEVELS) * BUCKETS + sketch.BLOCK

    def turn(part: DataFrame, model: Model | None) -> tuple[Model, float]:
        held = sc.broadcast((model.rates, model.mass, model.shares)) if model is not None else None
        return maximised(sketch.total(part.mapInArrow(_expected(held), "block int, salt int, counts binary"), size), model)

    model, _ = turn(table.where("rated IS NOT NULL"), None)
    trace: list[float] = []
    while len(trace) < most:
        then, now = turn(table, model)
        trace.append(now)
        model = then
        if len(trace) > 1 and trace[-1] - trace[-2] < gain * abs(trace[-1]):
            break
    return model, trace


def levels(documents: DataFrame, labels: DataFrame, least: int = 20, most: int = 12) -> DataFrame:
    """(doc_id, level, difficulty): for each English document (doc_id, text, lang) of at least `least` words its level on the scale of
    labels (doc_id, level, rater), and the mean of its levels' weights.

    Null levels, ratings out of 1..5 and repeated ratings of a rater don't count; null ids, texts and languages and other languages
    have no level; repeated rows are judged each; without a rated document there is no scale and no row; other columns are not read.
    """
    spark = documents.sparkSession
    docs = documents.where("lang = 'en' AND text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    given = labels.where("level BETWEEN 1 AND 5 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("id"), "level", "rater").distinct()
    vote = lambda k: F.exp(F.sum(F.log(F.when(F.col("level") == k, RATER[0]).when(F.abs(F.col("level") - k) == 1, RATER[1]).otherwise(RATER[2]))))
    votes = given.groupBy("id").agg(F.array(*(vote(int(k)) for k in LEVELS)).alias("v"))
    rated = votes.select("id", F.transform("v", lambda x: x / F.aggregate("v", F.lit(0.0), lambda a, y: a + y)).alias("rated"))
    held = stage(docs.mapInArrow(_occurrences(least), "id bigint, words array<int>"))
    table = stage(held.join(rated, "id", "left"))
    if table.where("rated IS NOT NULL").isEmpty():
        return spark.createDataFrame([], "doc_id bigint, level int, difficulty double")
    model, _ = estimate(table, most)
    plain = spark.sparkContext.broadcast((model.rates, model.mass, model.shares))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _normal(_logs(b, *plain.value)) if b.num_rows else np.zeros((0, len(LEVELS)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array((p.argmax(1) + 1).astype(np.int32)), pa.array(p @ LEVELS)], names=["doc_id", "level", "difficulty"])

    return held.mapInArrow(judge, "doc_id bigint, level int, difficulty double")
