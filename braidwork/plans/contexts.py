"""The contexts of the extraction strategies: one frame (document_id, context) each, made by the retrieval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions import text as txt
from braidwork.operators import chunks, filters, graph, ontology, retrieve, strategies

SHOWN = 40


def listed(rows: DataFrame, line: Column, order: str = "rank") -> DataFrame:
    """Rows (document_id, order, ...) as lines of each document in their order."""
    return rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("context"))


def triple_line() -> Column:
    return F.concat_ws(" ", F.lit("-"), "head", "rel", "tail")


def few_shots(documents: DataFrame, examples: DataFrame, n: int = 3, types: str | list[str] = "train", **slices) -> DataFrame:
    """STR2: the same n examples for every document: their texts and relations as JSON; n rows are broadcast."""
    shots = filters.few_shots(examples, n, [F.col("row_id")], types, **slices)
    one = shots.select("row_id", F.concat_ws("\n", F.lit("Example:"), strategies.document_text(), F.to_json("relations")).alias("l"))
    all_ = one.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "l"))), lambda x: x["l"]), "\n").alias("context"))
    return documents.select("document_id").join(F.broadcast(all_))


def kg(documents: DataFrame, edges: DataFrame, hops: int = 1, most: int = 200) -> DataFrame:
    """STR4: the neighbourhood of a document's entities."""
    return listed(graph.neighbourhood(documents, edges, hops, most), triple_line())


def triples(documents: DataFrame, edges: DataFrame, hops: int = 1, most: int = 80) -> DataFrame:
    """STR5: triples near a document's entities, by words shared with it."""
    return listed(graph.scored_triples(documents, edges, hops, most), triple_line())


def communities(documents: DataFrame, sentences: DataFrame, vectors: DataFrame, texts: DataFrame, embed, **limits) -> DataFrame:
    """STR6: sentences (sentence_id, text) of the communities nearest to a document's query; embed adds a column `vector` to a frame with a
    text column."""
    asked = embed(documents.select(F.col("document_id").alias("query_id"), chunks.query_text().alias("text"))).select("query_id", "vector")
    found = graph.two_stage(asked, sentences, vectors, **limits).join(texts.select("sentence_id", "text"), "sentence_id")
    return listed(found.withColumnRenamed("query_id", "document_id"), F.concat(F.lit("- "), F.col("text")))


def lines(documents: DataFrame, turtle_lines: DataFrame, index: DataFrame, **limits) -> DataFrame:
    """STR7: lines of the ontology around what a document's links name."""
    return ontology.line_context(documents, turtle_lines, index, **limits)


def sub_ontology(documents: DataFrame, rdf: DataFrame, labels: DataFrame, pick: str = "candidates", **limits) -> DataFrame:
    """STR8: the part of the ontology that fits a document's links, as Turtle."""
    wanted = ontology.targets(documents, pick)
    return ontology.turtle(ontology.fragment(ontology.properties(rdf, wanted, **limits), wanted, labels)).withColumnRenamed("ttl", "context")


def ontology_chunks(documents: DataFrame, table: DataFrame, k: int = 8, merge: int | None = None) -> DataFrame:
    """STR9: the leaf chunks nearest to a document's query, or their parents; blank queries find nothing."""
    asked = documents.select("document_id", chunks.query_text().alias("query")).where(F.col("query").rlike(r"(?U)\S"))
    found = retrieve.nearest_held(asked, table.where("is_leaf = 1"), ["document_id"], "query", "chunk_id", "text", k)
    if merge:
        return listed(chunks.merged(found, table, "document_id", merge), F.col("text"))
    return listed(found.join(table.select("chunk_id", "text"), "chunk_id"), F.coalesce("text", F.lit("")))


def ontology_and_kg(documents: DataFrame, linked: DataFrame, edges: DataFrame, most: int = SHOWN) -> DataFrame:
    """STR10, 11, 13, JN3: linked concepts (document_id, entity_id, rank, label) and at most `most` triples of a document."""
    concepts = linked.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("entity_id", F.lit(" is a "), "label"))), "\n").alias("c"))
    facts = listed(graph.distinct_neighbourhood(documents, edges, 1, most), triple_line()).withColumnRenamed("context", "t")
    both = documents.select("document_id").join(concepts, "document_id", "left").join(facts, "document_id", "left")
    return both.select("document_id", F.nullif(F.concat_ws("\n", "c", "t"), F.lit("")).alias("context"))


def looked_up(documents: DataFrame, table: DataFrame, plan: Column | None = None) -> DataFrame:
    """STR11, 12, RET24: texts looked up beforehand, table (key, text) by mention, for documents that the plan chooses."""
    keys = documents.where(plan if plan is not None else F.lit(True)).select("document_id", F.explode("entities").alias("entity_id", "e")).select("document_id", "entity_id", F.explode("e.mentions").alias("m"))
    named = keys.select("document_id", txt.mention_key(txt.mention_text(F.col("m"))).alias("key")).where("key IS NOT NULL").distinct()
    found = named.join(table.select(txt.mention_key("key").alias("key"), "text"), "key")
    return listed(found, F.concat_ws(": ", "key", "text"), "key")
