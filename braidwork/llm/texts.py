"""Steps that the near-same operators share: exact copies, fetching and verifying candidate pairs, classes and their members."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.words import words
from braidwork.session import stage

#: Candidate ids up to this number (16 MB) are broadcast to fetch their texts; more are joined by shuffle.
IDS = 1_000_000


def fingerprint(ws: list[str]) -> tuple[int, int]:
    """128 bits of a list of words, as two signed longs."""
    d = xxhash.xxh3_128_digest(" ".join(ws).encode("utf-8", "surrogatepass"))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def classes(copies: DataFrame, *more) -> DataFrame:
    """One row per text: copies (id, hi, lo, ...) -> (cls, hi, lo, more...), cls being the smallest id that has the text."""
    return copies.groupBy("hi", "lo").agg(F.min("id").alias("cls"), *more)


def same(a: list[str], b: list[str], one_in: int) -> bool:
    """Whether at most one word in `one_in` of the longer text is inserted, deleted or replaced, whatever the order of sentences."""
    long = max(len(a), len(b))
    if (long - min(len(a), len(b))) * one_in > long:
        return False
    count: dict[str, int] = {}
    for w in a:
        count[w] = count.get(w, 0) + 1
    for w in b:
        count[w] = count.get(w, 0) - 1
    more = sum(v for v in count.values() if v > 0)
    return max(more, more - len(a) + len(b)) * one_in <= long


def verified(pairs: DataFrame, texts: DataFrame, one_in: int) -> DataFrame:
    """Of pairs (a, b) of ids those whose texts (id, text) are near-same.  Only the texts of candidates are moved; pairs is read more
    than once, so it should be staged."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = ids.count()
    texts = texts.join(F.broadcast(ids) if few <= IDS else ids, "id", "left_semi") if few else texts.limit(0)
    texts = stage(texts.select("id", "text").dropDuplicates(["id"]))
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = [x.column(c).to_pylist() for c in ("a", "b")]
            known: dict[int, list[str]] = {}
            for own, text in zip(ids, ("ta", "tb"), strict=True):
                for k, t in zip(own, x.column(text).to_pylist(), strict=True):
                    if k not in known:
                        known[k] = words(t)
            ok = [same(known[s], known[t], one_in) for s, t in zip(*ids, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(check, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), the component being its smallest node: alternating large and small stars, each
    round staged, so rounds grow with the logarithm of the longest chain and no lineage builds up."""
    e = stage(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct())
    before = None
    while True:
        both = e.unionAll(e.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = stage(small)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.selectExpr("u AS node", "v AS component").unionAll(e.selectExpr("v AS node", "v AS component").distinct())
        before = now
