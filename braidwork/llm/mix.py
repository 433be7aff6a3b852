"""Mixing sources to target weights by hash thresholds on histograms.

Each document has a uniform hash.  Tokens are summed by source and leading bits of the hash; running sums give the bucket in which a
source's budget ends, and only that bucket is summed again by the next bits, until it holds one document.  A document is in the
mixture if its hash is below its source's threshold: no sorting, no draw, and a smaller budget takes a subset of a larger one's.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidwork.session import stage

# The published pattern by which this vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BITS, _STEP = 60, 12
#: Sources of a mixture, and bytes of a vocabulary, that are accepted: both are held by the driver and broadcast.
SOURCES, LARGEST = 10_000, 64 << 20


def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
    return tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of documents with text and source, tokens by a public byte-level vocabulary; the driver reads its file, tasks
    get its bytes."""
    if os.path.getsize(vocabulary) > LARGEST:
        raise ValueError("the vocabulary is too large to be broadcast")
    held = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(held.value)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL").mapInArrow(count, "doc_id bigint, source string, tokens bigint")


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows by source, at most SOURCES, for a broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def thresholds(counted: DataFrame, budgets: dict[str, int]) -> dict[str, int]:
    """For each source the hash below which its documents hold its budget of tokens, as near as whole documents allow.

    The bucket in which each budget ends is found by running sums in Spark; one row per source reaches the driver."""
    low = dict.fromkeys(budgets, 0)  # the budget ends in [low, low + 2 ** (bits left))
    left = dict(budgets)
    done: dict[str, int] = {}
    for shift in range(_BITS - _STEP, -1, -_STEP):
        rows = [(s, low[s], left[s]) for s in budgets if s not in done]
        if not rows:
            break
        within = counted.join(_small(counted.sparkSession, rows, "source string, low bigint, left bigint"), "source").withColumn("at", F.col("h") - F.col("low")).where((F.col("at") >= 0) & (F.col("at") < (1 << (shift + _STEP))))
        sums = within.groupBy("source", "left", F.shiftright("at", shift).alias("b")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        run = sums.withColumn("run", F.sum("tokens").over(Window.partitionBy("source").orderBy("b")))  # at most 2 ** _STEP rows a source
        ends = run.where("run > left").groupBy("source").agg(F.min(F.struct("b", "tokens", "n", "run")).alias("e")).select("source", "e.*").collect()
        for r in ends:
            s = r.source
            left[s] -= r.run - r.tokens
            low[s] += r.b << shift
            if r.n == 1 or shift == 0:
                done[s] = low[s] + ((1 << shift) if 2 * left[s] >= r.tokens else 0)
        ended = {r.source for r in ends}
        for s, *_ in rows:
            if s not in ended:
                done[s] = low[s] + (1 << (shift + _STEP))  # the budget holds all
    return done


def mixture(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, tokens, copies) and the shares reached (source, target_share, wanted_share, actual_share, available,
    tokens, documents, max_repeats).

    targets (source, target_share, max_repeats) is read to the driver: a parameter, checked to be at most SOURCES rows with one row per
    source.  A source without tokens can't be drawn from: it is reported with 0 and the others share by their targets (wanted_share); so
    is one whose share or repeats are null or not above 0, and its documents are not counted.  total is the size in tokens; without it the
    largest size at which no document is used more than its source's max_repeats times.  Where total is above that, sources give what they can
    and the report tells.  A source's documents are used equally often, or once more below its threshold.  Documents of other sources, null
    ids, texts and sources are left out; blank texts have few or no tokens and go with their hash; repeated rows have one hash and go
    together; other columns are not read.
    """
    rows = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL").distinct().limit(SOURCES + 1).collect()
    if len(rows) > SOURCES or len({r.source for r in rows}) < len(rows):
        raise ValueError(f"targets need one row per source, {SOURCES} at most")
    goal = {r.source: (r.target_share, r.max_repeats) for r in rows if (r.target_share or 0) > 0 and (r.max_repeats or 0) > 0}
    spark = documents.sparkSession
    known = documents.join(_small(spark, [(s,) for s in goal], "source string"), "source", "left_semi")
    counted = stage(token_counts(known, vocabulary).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 64 - _BITS)))
    have = {r.source: r.tokens for r in counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect() if r.tokens}  # at most SOURCES
    whole = sum(goal[s][0] for s in have) or 1.0
    share = {s: goal[s][0] / whole for s in have}
    size = min((have[s] * goal[s][1] / share[s] for s in have), default=0) if total is None else total
    need = {s: min(round(share[s] * size), have[s] * goal[s][1]) for s in have}
    times = {s: need[s] // have[s] for s in have}
    below = thresholds(counted, {s: need[s] - times[s] * have[s] for s in have if need[s] > times[s] * have[s]})
    drawn = counted.join(_small(spark, [(s, times[s], below.get(s, 0)) for s in have], "source string, times int, below bigint"), "source")
    drawn = drawn.select("doc_id", "source", "tokens", (F.col("times") + (F.col("h") < F.col("below")).cast("int")).alias("copies")).where("copies > 0")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"))
    plan = spark.createDataFrame([(r.source, float(r.target_share) if r.target_share is not None else None, share.get(r.source, 0.0), have.get(r.source, 0), r.max_repeats) for r in rows], "source string, target_share double, wanted_share double, available bigint, max_repeats int")
    reached = plan.join(got, "source", "left").fillna(0, ["tokens", "documents"])
    everything = got.agg(F.sum("tokens").alias("all_tokens"))
    shares = reached.join(F.broadcast(everything)).select("source", "target_share", "wanted_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), "available", "tokens", "documents", "max_repeats")
    return drawn, shares
