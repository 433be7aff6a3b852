"""Queries over knowledge graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import embed
from braidwork.operators import graph
from braidwork.plans.evaluation import LATEST, documents
from braidwork.plans.registry import query
from braidwork.sources.tables import table

#: Edges of gold relations with their order as a tuple of row, relation and pair.
EDGES = f"""WITH {LATEST}, rels AS (SELECT row_id, document_id, map_entries(relations) AS m FROM docs),
  rel_pos AS (SELECT row_id, document_id, m, unnest(range(1, len(m) + 1)) AS j FROM rels),
  pair_pos AS (SELECT row_id, document_id, j, m[j].key AS rel, m[j].value AS v, unnest(range(1, len(m[j].value) + 1)) AS i FROM rel_pos),
  edges AS (SELECT (row_id, j, i) AS o, v[i][1] AS head, rel, v[i][2] AS tail, document_id FROM pair_pos WHERE len(v[i]) = 2 AND v[i][1] IS NOT NULL AND v[i][2] IS NOT NULL),
  nodes AS (SELECT DISTINCT e.key AS id FROM (SELECT unnest(map_entries(entities)) AS e FROM docs) WHERE e.value IS NOT NULL),
  seeds AS (SELECT document_id, k[p] AS node, p AS pos FROM (SELECT document_id, map_keys(entities) AS k, unnest(range(1, len(map_keys(entities)) + 1)) AS p FROM docs))"""


def there(x: str) -> str:
    """SQL: a string with a character that is no space."""
    return f"regexp_matches({x}, '[^\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]')"


def triples(spark, d):
    return table(spark, d, "kg_triples").withColumnRenamed("triple_id", "edge_id")


@query("kg_gold_edges", f"{EDGES} SELECT head, rel, tail, document_id FROM edges")
def kg_gold_edges(spark, d):
    return graph.gold_edges(documents(spark, d)).drop("edge_order")


@query(
    "kg_stats",
    f"""{EDGES} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM edges) AS triples, (SELECT count(*) FROM (SELECT DISTINCT head, rel, tail FROM edges)) AS edges,
      (SELECT count(*) FROM (SELECT id FROM nodes UNION SELECT head FROM edges UNION SELECT tail FROM edges)) AS nodes""",
)
def kg_stats(spark, d):
    docs = documents(spark, d)
    return graph.stats(docs, graph.gold_nodes(docs), graph.gold_edges(docs))


@query(
    "kg_nodes",
    f"""{EDGES}, each AS (SELECT row_id, unnest(map_entries(entities)) AS x FROM docs),
    named AS (SELECT row_id, x.key AS id, x.value.type AS type, coalesce(list_filter(list_transform(x.value.mentions, lambda m: coalesce(nullif(trim(m.trigger_word), ''), nullif(trim(m.text), ''), nullif(trim(m.name), ''))), lambda t: t IS NOT NULL)[1], x.key) AS label
      FROM each WHERE x.value IS NOT NULL)
    SELECT id, arg_max(type, row_id) FILTER (type IS NOT NULL) AS type, arg_max(label, row_id) AS label FROM named GROUP BY id""",
)
def kg_nodes(spark, d):
    return graph.gold_nodes(documents(spark, d))


@query("kg_upsert", f"SELECT head, CASE WHEN {there('rel')} THEN rel ELSE 'RELATED' END AS rel, tail, min(triple_id) AS edge_id, count(*) AS copies FROM kg_triples WHERE {there('head')} AND {there('tail')} GROUP BY ALL")
def kg_upsert(spark, d):
    return graph.upsert_edges(triples(spark, d))


@query(
    "kg_neighbours",
    """WITH s AS (SELECT DISTINCT head AS seed FROM kg_triples WHERE triple_id % 100 = 0 AND head IS NOT NULL)
    SELECT seed, triple_id AS edge_id, rel, tail AS neighbour FROM kg_triples JOIN s ON head = seed UNION ALL SELECT seed, triple_id, rel, head FROM kg_triples JOIN s ON tail = seed""",
)
def kg_neighbours(spark, d):
    e = triples(spark, d)
    return graph.neighbours(e, e.where("edge_id % 100 = 0").select(F.col("head").alias("seed")), incoming=True)


_HOP2 = f"""{EDGES}, h1 AS (SELECT s.document_id, row_number() OVER (PARTITION BY s.document_id ORDER BY s.pos, o) AS n, head, rel, tail, s.pos, o FROM seeds s JOIN edges e ON s.node = e.head),
  f2 AS (SELECT document_id, tail AS node, min(n) AS "at" FROM h1 WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.document_id = h1.document_id AND s.node = h1.tail) GROUP BY ALL),
  walk AS (SELECT document_id, 1 AS hop, n AS "at", o, head, rel, tail FROM h1 UNION ALL SELECT f2.document_id, 2, f2."at", o, head, rel, tail FROM f2 JOIN edges ON node = head),
  ranked AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY hop, "at", o)::INT AS rank, hop::INT AS hop, head, rel, tail FROM walk)"""


@query("kg_bfs", f"{_HOP2} SELECT * FROM ranked WHERE rank <= 200 AND rel <> 'RESULT'")
def kg_bfs(spark, d):
    docs = documents(spark, d)
    return graph.neighbourhood(docs, graph.gold_edges(docs), 2).where("rel <> 'RESULT'")


@query(
    "kg_doc_triples",
    f"""{_HOP2}, once AS (SELECT document_id, head, rel, tail, min(rank) AS "at" FROM ranked GROUP BY ALL)
    SELECT document_id, rank, head, rel, tail FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY "at")::INT AS rank FROM once) WHERE rank <= 40""",
)
def kg_doc_triples(spark, d):
    docs = documents(spark, d)
    return graph.distinct_neighbourhood(docs, graph.gold_edges(docs), 2)


_TOKENS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


@query(
    "kg_scored_triples",
    f"""{EDGES}, al AS (SELECT document_id, x.key AS node, array_to_string(list_filter(list_transform(x.value.mentions[1:2], lambda m: coalesce(nullif(trim(m.trigger_word), ''), nullif(trim(m.text), ''), nullif(trim(m.name), ''))), lambda t: t IS NOT NULL), ' ') AS alias
      FROM (SELECT document_id, unnest(map_entries(entities)) AS x FROM docs)),
    said AS (SELECT document_id, {_TOKENS("concat_ws(' ', title, text, array_to_string(sentences, ' '))")} AS said FROM docs),
    found AS (SELECT DISTINCT s.document_id, o, head, rel, tail FROM seeds s JOIN edges e ON s.node = e.head OR s.node = e.tail),
    scored AS (SELECT f.document_id, o, f.head, f.rel, f.tail, len(list_intersect({_TOKENS("concat_ws(' ', f.head, coalesce(h.alias, ''), f.rel, f.tail, coalesce(t.alias, ''))")}, said))
      + (h.node IS NOT NULL)::INT + (t.node IS NOT NULL)::INT + CASE WHEN list_contains(said, lower(f.rel)) THEN 0.5 ELSE 0 END::DOUBLE AS score
      FROM found f LEFT JOIN al h ON h.document_id = f.document_id AND h.node = f.head LEFT JOIN al t ON t.document_id = f.document_id AND t.node = f.tail JOIN said ON said.document_id = f.document_id)
    SELECT document_id, rank, head, rel, tail, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, o)::INT AS rank FROM scored) WHERE rank <= 80""",
)
def kg_scored_triples(spark, d):
    docs = documents(spark, d)
    return graph.scored_triples(docs, graph.gold_edges(docs))


@query("kg_weighted_pairs", "SELECT least(head, tail) AS a, greatest(head, tail) AS b, count(*) AS weight FROM kg_triples WHERE head <> tail GROUP BY ALL")
def kg_weighted_pairs(spark, d):
    return graph.weighted_pairs(triples(spark, d))


@query("kg_communities")
def kg_communities(spark, d):
    return graph.communities(graph.weighted_pairs(triples(spark, d)))


@query("kg_two_stage")
def kg_two_stage(spark, d):
    """Sentences of the graph answering concepts: communities first, then their sentences."""
    from braidwork.plans.retrieval import concept_queries

    e = triples(spark, d).where("trim(head) <> '' AND trim(tail) <> ''")
    label = graph.communities(graph.weighted_pairs(e))
    sentences = graph.sentence_communities(e, label)
    said = e.where("sentence_id IS NOT NULL").groupBy("sentence_id").agg(F.min(F.struct("edge_id", F.concat_ws(" ", "head", "rel", "tail").alias("text")))["text"].alias("text"))
    return graph.two_stage(embed.embed(concept_queries(spark, d), "query"), sentences, embed.embed(said, "text"), delta_percent=1.0)
