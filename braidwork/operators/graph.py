"""Property graphs as two frames: building, upserts, neighbourhoods, communities.

nodes (id, attributes map) and edges (edge_id, head, rel, tail, ...), edge_id giving the insertion order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions import text as txt
from braidwork.operators.filters import top, with_labels
from braidwork.session import stage


def gold_edges(documents: DataFrame) -> DataFrame:
    """IDX5: an edge for each well-formed pair of the documents' relations (row_id, document_id, relations), with a total insertion
    order (row_id, relation, pair) as edge_order and the document it comes from."""
    pairs = documents.select("row_id", "document_id", F.posexplode("relations").alias("rel_pos", "rel", "pairs")).select("row_id", "document_id", "rel_pos", "rel", F.posexplode("pairs").alias("pos", "pair"))
    from braidwork.operators.filters import well_formed

    pairs = pairs.where(well_formed(F.col("pair")))
    return pairs.select(F.struct("row_id", "rel_pos", "pos").alias("edge_order"), F.col("pair")[0].alias("head"), "rel", F.col("pair")[1].alias("tail"), "document_id")


def gold_nodes(documents: DataFrame) -> DataFrame:
    """IDX5: the entities of the documents; later attributes overwrite earlier ones key by key."""
    each = documents.select("row_id", F.explode("entities").alias("id", "e")).where(F.col("e").isNotNull())
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("row_id", F.col(c).alias("v"))))["v"]
    each = each.select("row_id", "id", F.col("e.type").alias("type"), txt.entity_label(F.col("e"), F.col("id")).alias("label"))
    return each.groupBy("id").agg(last("type").alias("type"), last("label").alias("label"))


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SET4: node ids of nodes and of the ends of edges, each once."""
    return nodes.select("id").unionAll(edges.select(F.explode(F.array("head", "tail")).alias("id"))).where("id IS NOT NULL").distinct()


def stats(documents: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG10: documents, triples, distinct edges and nodes, ends of edges being nodes."""
    one = documents.agg(F.count("*").alias("documents"))
    two = edges.agg(F.count("*").alias("triples"))
    three = edges.select("head", "rel", "tail").distinct().agg(F.count("*").alias("edges"))
    four = with_endpoints(nodes, edges).agg(F.count("*").alias("nodes"))
    return one.join(two).join(three).join(four)


def upsert_edges(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """IDX6: each (head, rel, tail) once, the first in order; a null or blank rel is RELATED, edges without head or tail go."""
    e = edges.withColumn("rel", F.when(F.col("rel").rlike(r"(?U)\S"), F.col("rel")).otherwise("RELATED")).where(F.col("head").rlike(r"(?U)\S") & F.col("tail").rlike(r"(?U)\S"))
    return e.groupBy("head", "rel", "tail").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def upsert_nodes(nodes: DataFrame, order: str = "pos") -> DataFrame:
    """IDX6, IDX7: nodes (id, attributes map, order) merged by id, later attributes overwriting earlier ones key by key."""
    each = nodes.select("id", order, F.explode_outer("attributes").alias("k", "v"))
    last = each.groupBy("id", "k").agg(F.max_by("v", order).alias("v"))
    return last.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("attributes"))


def neighbours(edges: DataFrame, seeds: DataFrame, incoming: bool = False) -> DataFrame:
    """IDX6: (seed, edge_id, rel, neighbour) of the outgoing edges of seeds (seed), and of the incoming ones if asked."""
    out = edges.join(seeds.select(F.col("seed").alias("head")).distinct(), "head").select(F.col("head").alias("seed"), "edge_id", "rel", F.col("tail").alias("neighbour"))
    if not incoming:
        return out
    return out.unionAll(edges.join(seeds.select(F.col("seed").alias("tail")).distinct(), "tail").select(F.col("tail").alias("seed"), "edge_id", "rel", F.col("head").alias("neighbour")))


class GraphStore:
    """IDX6: the store's surface: upserts give a new store, query takes 'nodes', 'edges' or 'neighbors:<id>'."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def upsert(self, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> GraphStore:
        n = self.nodes if nodes is None else upsert_nodes(self.nodes.withColumn("pos", F.lit(0)).unionByName(nodes.withColumn("pos", F.lit(1))))
        if edges is None:
            return GraphStore(n, self.edges)
        both = self.edges.select("edge_id", "head", "rel", "tail").unionByName(edges.select("edge_id", "head", "rel", "tail"))
        return GraphStore(n, upsert_edges(both).select("edge_id", "head", "rel", "tail"))

    def query(self, text: str) -> DataFrame:
        if text == "nodes":
            return self.nodes
        if text == "edges":
            return self.edges
        if text.startswith("neighbors:"):
            return self.edges.where(F.col("head") == text.partition(":")[2])
        raise ValueError(f"unknown query {text!r}")


def seeds(documents: DataFrame) -> DataFrame:
    """(document_id, node, pos): the entities of each document in their order."""
    return documents.select("document_id", F.posexplode(F.map_keys("entities")).alias("pos", "node"))


def neighbourhood(documents: DataFrame, edges: DataFrame, hops: int = 1, most: int = 200, hop_relations: list[str] | None = None, post_relations: list[str] | None = None) -> DataFrame:
    """RET12, JN6: (document_id, rank, hop, head, rel, tail): outgoing edges within `hops` of each document's entities, by hop, order of
    discovery and edge order, cut to `most` before the relations of the fragment are filtered (hop_relations filters during the
    walk).  Triples may repeat; a node is expanded once."""
    allowed = with_labels(edges, hop_relations)
    frontier = seeds(documents).select("document_id", "node", F.struct(F.col("pos").cast("bigint")).alias("at"))
    visited = frontier.select("document_id", "node")
    found = None
    for hop in range(1, hops + 1):
        step = frontier.join(allowed, F.col("node") == F.col("head")).select(frontier["document_id"], F.lit(hop).alias("hop"), "at", "edge_order", "head", "rel", "tail")
        if hop < hops:
            step = stage(step.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("at", "edge_order"))))
            frontier = step.groupBy("document_id", F.col("tail").alias("node")).agg(F.struct(F.min("n").cast("bigint")).alias("at")).join(visited, ["document_id", "node"], "left_anti")
            visited = visited.unionAll(frontier.select("document_id", "node"))
            step = step.select("document_id", "hop", F.struct(F.col("n").cast("bigint")).alias("at"), "edge_order", "head", "rel", "tail")
        found = step if found is None else found.unionAll(step)
    ranked = top(found, ["document_id"], [F.col("hop"), F.col("at"), F.col("edge_order")], most)
    return with_labels(ranked, post_relations).select("document_id", "rank", "hop", "head", "rel", "tail")


def distinct_neighbourhood(documents: DataFrame, edges: DataFrame, hops: int = 1, most: int = 40, relations: list[str] | None = None) -> DataFrame:
    """RET13: as neighbourhood(), each triple of a document once, where it was first found; the first `most`."""
    every = neighbourhood(documents, edges, hops, 2**31 - 1, relations)
    once = every.groupBy("document_id", "head", "rel", "tail").agg(F.min("rank").alias("at"))
    return top(once, ["document_id"], [F.col("at")], most).select("document_id", "rank", "head", "rel", "tail")


def aliases(documents: DataFrame, most: int = 2) -> DataFrame:
    """(document_id, node, alias): the first texts of each entity's mentions."""
    each = documents.select("document_id", F.explode("entities").alias("node", "e"))
    texts = F.filter(F.transform(F.slice(F.coalesce(F.col("e.mentions"), F.array().cast("array<struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int,token_id:int,offset:array<int>>>")), 1, most), txt.mention_text), lambda t: t.isNotNull())
    return each.select("document_id", "node", F.array_join(texts, " ").alias("alias"))


def scored_triples(documents: DataFrame, edges: DataFrame, hops: int = 1, most: int = 80) -> DataFrame:
    """RET14, WIN6: edges in either direction within `hops` of a document's entities, by the words that the triple (with the aliases
    of its ends) shares with the document, + 1 for each end that is an entity of it, + 0.5 if the relation is one of its words; ties by
    edge order."""
    frontier = seeds(documents).select("document_id", "node")
    seen = frontier
    found = None
    for hop in range(hops):
        out = frontier.join(edges, F.col("node") == F.col("head"))
        into = frontier.join(edges, F.col("node") == F.col("tail"))
        step = out.unionAll(into).select(frontier["document_id"], "edge_order", "head", "rel", "tail")
        found = step if found is None else found.unionAll(step)
        if hop + 1 < hops:
            frontier = step.select("document_id", F.explode(F.array("head", "tail")).alias("node")).distinct().join(seen, ["document_id", "node"], "left_anti")
            seen = seen.unionAll(frontier)
    found = found.dropDuplicates(["document_id", "edge_order"])
    names = aliases(documents)
    said = documents.select("document_id", txt.alnum_tokens(F.concat_ws(" ", "title", "text", F.array_join("sentences", " "))).alias("said"))
    both = found.join(names.toDF("document_id", "head", "ha"), ["document_id", "head"], "left").join(names.toDF("document_id", "tail", "ta"), ["document_id", "tail"], "left").join(said, "document_id")
    triple = txt.alnum_tokens(F.concat_ws(" ", "head", F.coalesce("ha", F.lit("")), "rel", "tail", F.coalesce("ta", F.lit(""))))
    score = F.size(F.array_intersect(triple, F.col("said"))) + F.col("ha").isNotNull().cast("double") + F.col("ta").isNotNull().cast("double") + F.when(F.array_contains("said", F.lower("rel")), 0.5).otherwise(0.0)
    return top(both.withColumn("score", score), ["document_id"], [F.desc("score"), F.col("edge_order")], most).select("document_id", "rank", "head", "rel", "tail", "score")


def weighted_pairs(edges: DataFrame) -> DataFrame:
    """AGG9: (a, b, weight), a < b: how often an undirected pair is an edge; loops go."""
    return edges.where("head <> tail").groupBy(F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")).agg(F.count("*").alias("weight"))


def communities(pairs: DataFrame, rounds: int = 8) -> DataFrame:
    """IDX8: (node, community) by label propagation: in each round a node takes the label of most weight among its neighbours and its
    own (weight 1), ties to the smallest label; deterministic, a fixed number of rounds at most, each of them staged.  Communities
    differ from those of modularity search, which is not deterministic."""
    both = stage(pairs.unionAll(pairs.selectExpr("b AS a", "a AS b", "weight")))
    label = both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for _ in range(rounds):
        votes = both.join(label, both["b"] == label["node"]).select(F.col("a").alias("node"), "community", "weight").unionAll(label.select("node", "community", F.lit(1).cast("bigint").alias("weight")))
        tally = votes.groupBy("node", "community").agg(F.sum("weight").alias("w"))
        new = stage(tally.groupBy("node").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community")))
        moved = new.join(label.toDF("node", "old"), "node").where("community <> old").isEmpty()
        label = new
        if moved:
            break
    return label


def sentence_communities(edges: DataFrame, label: DataFrame) -> DataFrame:
    """IDX9, AGG11: (community, sentence_id, pos): each sentence with the community of its edge's head, else tail, at its first edge."""
    head, tail = label.toDF("head", "hc"), label.toDF("tail", "tc")
    placed = edges.join(head, "head", "left").join(tail, "tail", "left").withColumn("community", F.coalesce("hc", "tc"))
    return placed.where("community IS NOT NULL AND sentence_id IS NOT NULL").groupBy("community", "sentence_id").agg(F.min("edge_id").alias("pos"))


def _added(batches: Iterator[pa.RecordBatch], unit: bool) -> Iterator[pa.RecordBatch]:
    """Sums (community, n, vector) of rows (community, n, vector), a row for each community of a batch; of sorted rows with unit the sums of
    whole communities, scaled to unit length, those of length 0 left out."""
    names = ["community", "n", "vector"]
    open_: tuple | None = None  # the community that the next batch may continue

    def out(keys: list, n: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        if unit:
            norm = np.sqrt((x * x).sum(1))
            keep = norm > 0
            keys, n, x = [k for k, ok in zip(keys, keep.tolist(), strict=True) if ok], n[keep], x[keep] / norm[keep, None]
        flat = pa.array(x.ravel())
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] if len(x) else 0))
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(n), pa.ListArray.from_arrays(offsets, flat)], names=names)

    kind = pa.string()
    for b in batches:
        if not b.num_rows:
            continue
        kind = b.schema.types[0]
        code = b.column(0).dictionary_encode()
        at = code.indices.to_numpy()
        x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        sums, n = np.add.reduceat(x[order], begin, axis=0), np.add.reduceat(b.column(1).to_numpy()[order], begin)
        keys = [code.dictionary[k].as_py() for k in at[order][begin].tolist()]
        if not unit:
            yield out(keys, n, sums)
            continue
        if open_ is not None:
            if open_[0] == keys[0]:
                n[0] += open_[1]
                sums[0] += open_[2]
            else:
                yield out([open_[0]], np.array([open_[1]]), open_[2][None, :])
        open_ = keys[-1], n[-1], sums[-1]
        yield out(keys[:-1], n[:-1], sums[:-1])
    if open_ is not None:
        yield out([open_[0]], np.array([open_[1]]), open_[2][None, :])


def unit_means(vectors: DataFrame) -> DataFrame:
    """(community, vector): the mean of the vectors (community, vector) of each community, scaled to unit length; without those of length 0.
    Vectors are added up before they are shuffled, so a community that holds most of them is no burden to one task."""
    schema = f"community {vectors.schema['community'].dataType.simpleString()}, n bigint, vector array<double>"
    part = vectors.select("community", F.lit(1).cast("bigint").alias("n"), "vector").mapInArrow(lambda b: _added(b, False), schema)
    return part.repartition("community").sortWithinPartitions("community").mapInArrow(lambda b: _added(b, True), schema).select("community", "vector")


def _likeness(held, names: list[str]):
    """Dot products of the vectors of sentences with those of the queries that chose their community."""

    def likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            asked = b.column("asked")
            row = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            each = asked.flatten()
            which, cr = each.field("q").to_numpy(), each.field("cr")
            dot = np.concatenate([np.einsum("ij,ij->i", x[row[c : c + 4096]], q[which[c : c + 4096]]) for c in range(0, len(row), 4096)]) if len(row) else np.zeros(0)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), *(b.column(n).take(take) for n in ("community", "sentence_id", "pos")), cr, pa.array(np.round(dot, 9) + 0.0)], names=names)

    return likeness


def two_stage(queries: DataFrame, sentences: DataFrame, vectors: DataFrame, top_communities: int = 3, top_sentences: int = 10, delta_percent: float | None = None, lambda_percent: float | None = None, most: int | None = None) -> DataFrame:
    """RET20, WIN7: for each query (query_id, vector) the best sentences of its best communities: (query_id, sentence_id, community,
    score, rank).  sentences is (community, sentence_id, pos), vectors (sentence_id, vector); communities are compared by the mean of
    their sentences' vectors, those without any likeness to a query being left out; delta_percent and lambda_percent are shares of the communities
    and of the scored candidates kept; most cuts the candidates of a query, in the order of their communities, before they are scored.

    Queries are held by the tasks, in passes if they are many; means and sentences are compared with them by one product a batch."""
    from braidwork.operators import retrieve

    double = F.transform("vector", lambda x: x.cast("double")).alias("vector")
    once = top(sentences, ["sentence_id"], [F.col("pos"), F.col("community")], 1).select("community", "sentence_id", "pos")
    placed = stage(once.join(vectors.select("sentence_id", double), "sentence_id"))
    keep = top_communities
    if delta_percent is not None:
        keep = max(1, math.ceil(delta_percent / 100.0 * placed.select("community").distinct().count() - 1e-9))
    asked = stage(queries.select("query_id", double))
    near = stage(retrieve.nearest(asked, unit_means(placed), "query_id", "community", "vector", keep, "dot", None).where("score <> 0"))
    kinds = {f.name: f.dataType.simpleString() for f in [*placed.schema, *asked.schema]}
    schema = f"query_id {kinds['query_id']}, community {kinds['community']}, sentence_id {kinds['sentence_id']}, pos {kinds['pos']}, cr int, score double"
    names = ["query_id", "community", "sentence_id", "pos", "cr", "score"]
    passes = max(1, -(-asked.count() // retrieve.QUERIES))
    scored = None
    for p in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p).toArrow()  # about QUERIES rows
        if not rows.num_rows:
            continue
        ids = rows.column("query_id").combine_chunks()
        matrix = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        number = queries.sparkSession.createDataFrame(pa.table({"query_id": ids, "q": pa.array(np.arange(rows.num_rows))}))
        chosen = near.join(F.broadcast(number), "query_id").groupBy("community").agg(F.collect_list(F.struct("q", F.col("rank").alias("cr"))).alias("asked"))  # a row for each query at most
        shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))
        one = placed.join(chosen, "community").select("community", "sentence_id", "pos", "vector", "asked").mapInArrow(_likeness(shared, names), schema)
        scored = one if scored is None else scored.unionAll(one)
    if scored is None:
        scored = queries.sparkSession.createDataFrame([], schema)
    if most is not None:
        scored = top(scored, ["query_id"], [F.col("cr"), F.col("pos"), F.col("sentence_id")], most, "at")
    ranked = top(scored, ["query_id"], [F.desc("score"), F.col("cr"), F.col("pos"), F.col("sentence_id")], None)
    if lambda_percent is not None:
        n = F.count("*").over(Window.partitionBy("query_id"))
        ranked = ranked.withColumn("n", n).where(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.lit(lambda_percent / 100.0) * F.col("n"))))
    return ranked.where(F.col("rank") <= top_sentences).select("query_id", "sentence_id", "community", "score", "rank")
