"""Queries that retrieve: hashed and given vectors, fusion, overlap, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import embed
from braidwork.operators import retrieve
from braidwork.plans.registry import query
from braidwork.sources.tables import table

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '{SPACE}'), lambda w: w <> '')"


def vectors_sql(name: str, source: str, key: str, where: str = "true", text: str = "text") -> str:
    return f"""{name}_t AS (SELECT {key} AS id, unnest({words_sql(text)}) AS t FROM {source} WHERE {where}),
  {name}_n AS (SELECT id, ('0x' || substr(md5(t), 31, 2))::INT AS bucket, count(*) AS n FROM {name}_t GROUP BY ALL),
  {name} AS (SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS weight FROM {name}_n)"""


def dense_sql(k: int, where: str = "true") -> str:
    return f"""WITH {vectors_sql('d', 'documents', 'doc_id', where)}, {vectors_sql('q', 'eval_passages', 'item_id')},
  dots AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.weight * d.weight), 9) AS score FROM d JOIN q USING (bucket) GROUP BY ALL),
  dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM dots) WHERE rank <= {k})"""


@query("hash_embed", f"WITH {vectors_sql('d', 'documents', 'doc_id')} SELECT id AS doc_id, bucket, round(weight, 9) AS weight FROM d")
def hash_embed(spark, d):
    return embed.sparse(table(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 9))


def _dense(spark, d, where: str = "true", k: int = 5):
    return retrieve.nearest(table(spark, d, "eval_passages"), table(spark, d, "documents").where(where), "item_id", "doc_id", "text", k)


@query("dense_topk", f"{dense_sql(5)} SELECT * FROM dense")
def dense_topk(spark, d):
    return _dense(spark, d)


@query("dense_filtered_topk", f"""{dense_sql(5, "lang = 'en' AND source = 'incident_report'")} SELECT * FROM dense""")
def dense_filtered_topk(spark, d):
    return _dense(spark, d, "lang = 'en' AND source = 'incident_report'")


_ITEMS = "q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 100 = 0), i AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)"


def _vector_sql(score: str) -> str:
    return f"WITH {_ITEMS}, s AS (SELECT query_id, vec_id, round({score}, 6) AS score FROM q, i) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"


def _vectors(spark, d, score):
    e = table(spark, d, "embeddings")
    return retrieve.nearest(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, "query_id", "vec_id", "embedding", 10, score, None, 6)


@query("vector_cosine_topk", _vector_sql("list_cosine_similarity(qv, v)"))
def vector_cosine_topk(spark, d):
    return _vectors(spark, d, "cosine")


@query("vector_l2_inverse_topk", _vector_sql("1 / (1 + list_distance(qv, v))"))
def vector_l2_inverse_topk(spark, d):
    return _vectors(spark, d, "l2_inverse")


@query(
    "vector_centroids",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM e GROUP BY ALL)
    SELECT label, (dim - 1)::INT AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM m""",
)
def vector_centroids(spark, d):
    return retrieve.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


_CONCEPTS = "queries AS (SELECT uri AS query_id, concat_ws(' ', label, array_to_string(aliases, ' ')) AS query FROM ontology_concepts)"
_GRAPH_WORDS = lambda x: f"list_distinct({words_sql(f'''translate({x}, '_-', '  ')''')})"
OVERLAP = f"""{_CONCEPTS}, qw AS (SELECT query_id, unnest({_GRAPH_WORDS('query')}) AS w FROM queries),
  ew AS (SELECT triple_id AS edge_id, unnest({_GRAPH_WORDS("concat_ws(' ', head, coalesce(rel, 'RELATED'), tail)")}) AS w FROM kg_triples),
  hits AS (SELECT query_id, edge_id, count(*)::DOUBLE AS score FROM ew JOIN qw USING (w) GROUP BY ALL),
  guided AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, edge_id)::INT AS rank FROM hits) WHERE rank <= 10)"""


def concept_queries(spark, d):
    return table(spark, d, "ontology_concepts").select(F.col("uri").alias("query_id"), F.concat_ws(" ", "label", F.array_join("aliases", " ")).alias("query"))


def guided(spark, d):
    edges = table(spark, d, "kg_triples").selectExpr("triple_id AS edge_id", "head AS source", "rel AS type", "tail AS target", "document_id")
    return retrieve.overlap(concept_queries(spark, d), edges)


@query(
    "kg_guided_topk",
    f"""WITH {OVERLAP} SELECT g.query_id, g.edge_id, g.score, g.rank, concat(coalesce(head, ''), ' —', coalesce(rel, 'RELATED'), '→ ', coalesce(tail, '')) AS evidence, coalesce(document_id, head) AS document_id
    FROM guided g JOIN kg_triples t ON t.triple_id = g.edge_id""",
)
def kg_guided_topk(spark, d):
    return guided(spark, d)


_TITLES = f"""{vectors_sql('t', 'documents', 'doc_id', text='title')}, td AS (SELECT q.id AS item_id, t.id AS doc_id, round(sum(q.weight * t.weight), 9) AS score FROM t JOIN q USING (bucket) GROUP BY ALL),
  titled AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM td) WHERE rank <= 5)"""


@query(
    "rrf_fusion",
    f"""{dense_sql(5)}, {_TITLES}, b AS (SELECT item_id, doc_id, rank, 0 AS no FROM dense UNION ALL SELECT item_id, doc_id, rank, 1 FROM titled),
    f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min((no, rank)) AS first FROM b GROUP BY item_id, doc_id)
    SELECT item_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, "first")::INT AS rank FROM f) WHERE rank <= 5""",
)
def rrf_fusion(spark, d):
    """Documents found by text and by title, fused."""
    titles = table(spark, d, "documents").select("doc_id", F.col("title").alias("text"))
    by_title = retrieve.nearest(table(spark, d, "eval_passages"), titles, "item_id", "doc_id", "text").where("score > 0")
    return retrieve.fuse([_dense(spark, d), by_title], ["doc_id"], "item_id")
