"""Chunks: sliding windows of words, two-level hierarchies, leaf search and merging into parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.filters import top


def words(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """IDX1: slices of `size` words begun every max(1, size - overlap) words, the short last ones kept; none of an empty array."""
    step = max(1, size - max(0, overlap))

    def cut(t: Column) -> Column:
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(step)), lambda i: F.slice(t, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))

    return F.get(F.transform(F.array(tokens), cut), F.lit(0))  # the words are bound once, not made again for each window


def label(x: Column | str) -> Column:
    """IDX2: the last part of the first word that is a web address, else the first six words; at most 60 characters."""
    w = words(x)
    uri = F.get(F.filter(w, lambda t: t.startswith("<http") | t.startswith("http")), F.lit(0))
    end = F.element_at(F.split(F.regexp_replace(uri, "^<+|>+$", ""), "/"), -1)
    return F.substring(F.coalesce(end, F.nullif(F.array_join(F.slice(w, 1, 6), " "), F.lit("")), F.lit("ontology_chunk")), 1, 60)


def hierarchy(texts: DataFrame, key: str, text: str, sizes: tuple[int, int] = (512, 128), overlap: int = 128, most_chars: int | None = None) -> DataFrame:
    """IDX1: (key, chunk, level, is_leaf, parent, subject_label, text) per text: windows of sizes[0] words, each followed by the windows
    of sizes[1] words of its text; chunks are counted from 0 within a text, in that order.  most_chars cuts the text of each window, as
    an index with such a limit does.  Numbers are counted within a row: nothing is shuffled."""
    cut = (lambda t: t) if most_chars is None else lambda t: F.substring(t, 1, most_chars)
    joined = lambda w: cut(F.array_join(w, " "))
    again = (lambda w: w) if most_chars is None else lambda w: words(joined(w))
    both = F.transform(windows(words(text), sizes[0], overlap), lambda w: F.struct(joined(w).alias("text"), F.transform(windows(again(w), sizes[1], overlap), joined).alias("leaves")))
    made = texts.select(key, both.alias("both"))
    # the number of a window is that of its predecessors and all their leaves
    starts = F.aggregate(F.transform("both", lambda p: F.size(p["leaves"])), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + 1 + n)))
    made = made.withColumn("starts", starts).select(key, "starts", F.posexplode("both").alias("i", "b"))
    made = made.select(key, F.struct(F.get("starts", F.col("i")).alias("n"), F.col("b.text").alias("text"), F.col("b.leaves").alias("leaves")).alias("p"))
    leaf = lambda t, i: F.struct((F.col("p.n") + 1 + i).alias("chunk"), F.col("p.n").alias("parent"), t.alias("text"))
    own = F.struct(F.col("p.n").alias("chunk"), F.lit(None).cast("int").alias("parent"), F.col("p.text").alias("text"))
    rows = made.select(key, F.explode(F.concat(F.array(own), F.transform("p.leaves", leaf))).alias("r"))
    level = F.col("r.parent").isNotNull().cast("int")
    return rows.select(key, "r.chunk", level.alias("level"), level.alias("is_leaf"), "r.parent", label("r.text").alias("subject_label"), "r.text")


def whole(documents: DataFrame) -> DataFrame:
    """IDX14: one chunk per document (id, text): <id>-c0."""
    return documents.select(F.concat(F.col("id").cast("string"), F.lit("-c0")).alias("chunk_id"), F.col("id").cast("string").alias("document_id"), "text", F.lit(0).alias("index"))


def merged(hits: DataFrame, chunks: DataFrame, query_id: str, k: int = 6) -> DataFrame:
    """RET19, JN13, SET3: (query_id, chunk_id, rank, text): the parents of the leaves found (query_id, chunk_id, rank), each once where
    first seen, the leaf itself where its parent is lost; the first k."""
    have = chunks.select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("there"))
    up = hits.join(chunks.select("chunk_id", "parent_id"), "chunk_id").join(have, "parent_id", "left")
    target = F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("chunk_id"))
    once = up.groupBy(query_id, target.alias("target")).agg(F.min("rank").alias("at"))
    ranked = top(once, [query_id], [F.col("at")], k)
    return ranked.join(chunks.select(F.col("chunk_id").alias("target"), "text"), "target").select(query_id, F.col("target").alias("chunk_id"), "rank", "text")


def query_text() -> Column:
    """RET21: title, the first three sentences (or 800 characters of the text), and up to six first mentions, a line each."""
    from braidwork.functions.text import mention_text

    empty = F.array().cast("array<string>")
    first = F.filter(F.transform(F.map_values("entities"), lambda e: mention_text(F.get(e["mentions"], F.lit(0)))), lambda t: t.isNotNull())
    said = F.when(F.size("sentences") > 0, F.array_join(F.slice("sentences", 1, 3), "\n")).otherwise(F.substring("text", 1, 800))
    return F.array_join(F.filter(F.concat(F.array("title", said), F.slice(F.coalesce(first, empty), 1, 6)), lambda t: t.isNotNull() & (t != "")), "\n")
