"""Queries over ontologies and their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import chunks, ontology, retrieve
from braidwork.plans.evaluation import LATEST, documents
from braidwork.plans.registry import query
from braidwork.plans.retrieval import SPACE, concept_queries, vectors_sql
from braidwork.sources import turtle
from braidwork.sources.tables import table

_WORDS = lambda x: f"list_filter(regexp_split_to_array(coalesce({x}, ''), '{SPACE}'), lambda w: w <> '')"
#: A label in SQL, as chunks.label().
_LABEL = lambda x: f"""substr(coalesce(regexp_extract(regexp_replace(list_filter({_WORDS(x)}, lambda w: starts_with(w, '<http') OR starts_with(w, 'http'))[1], '^<+|>+$', '', 'g'), '[^/]*$'), nullif(array_to_string({_WORDS(x)}[1:6], ' '), ''), 'ontology_chunk'), 1, 60)"""


@query("chunk_label", f"SELECT chunk_id, {_LABEL('text')} AS label FROM chunk_orag_chunks")
def chunk_label(spark, d):
    return table(spark, d, "chunk_orag_chunks").select("chunk_id", chunks.label("text").alias("label"))


@query(
    "chunk_windows",
    f"""SELECT doc_id, ((i - 1) // 48)::INT AS pos, array_to_string(w[i:i + 63], ' ') AS text FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, 48)) AS i FROM (SELECT doc_id, {_WORDS('text')} AS w FROM documents))""",
)
def chunk_windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.posexplode(chunks.windows(chunks.words("text"), 64, 16)).alias("pos", "w"))
    return w.select("doc_id", "pos", F.array_join("w", " ").alias("text"))


@query(
    "chunk_hierarchy",
    f"""WITH p AS (SELECT doc_id, i AS p, array_to_string(w[i:i + 127], ' ') AS text FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1, 112)) AS i FROM (SELECT doc_id, {_WORDS('text')} AS w FROM documents))),
    l AS (SELECT doc_id, p, i, array_to_string(w[i:i + 31], ' ') AS text FROM (SELECT doc_id, p, w, unnest(range(1, len(w) + 1, 16)) AS i FROM (SELECT doc_id, p, {_WORDS('text')} AS w FROM p))),
    b AS (SELECT doc_id, p, -1 AS i, text FROM p UNION ALL SELECT * FROM l), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY p, i) - 1)::INT AS chunk FROM b)
    SELECT doc_id, chunk, CASE WHEN i < 0 THEN 0 ELSE 1 END::INT AS level, CASE WHEN i < 0 THEN 0 ELSE 1 END::INT AS is_leaf, CASE WHEN i >= 0 THEN min(chunk) OVER (PARTITION BY doc_id, p) END AS parent, {_LABEL('text')} AS subject_label, text FROM n""",
)
def chunk_hierarchy(spark, d):
    return chunks.hierarchy(table(spark, d, "documents"), "doc_id", "text", (128, 32), 16)


_LEAF = f"""WITH queries AS (SELECT uri AS query_id, concat_ws(' ', label, array_to_string(aliases, ' ')) AS text FROM ontology_concepts), {vectors_sql('c', 'chunk_orag_chunks', 'chunk_id', 'is_leaf = 1')}, {vectors_sql('q', 'queries', 'query_id')},
  dots AS (SELECT q.id AS query_id, c.id AS chunk_id, round(sum(q.weight * c.weight), 9) AS score FROM c JOIN q USING (bucket) GROUP BY ALL),
  leaf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM dots) WHERE rank <= 8)"""


def _leaves(spark, d):
    leaf = table(spark, d, "chunk_orag_chunks").where("is_leaf = 1")
    return retrieve.nearest(concept_queries(spark, d).withColumnRenamed("query", "text"), leaf, "query_id", "chunk_id", "text", 8).where("score > 0")


@query("chunk_leaf_topk", f"{_LEAF} SELECT * FROM leaf")
def chunk_leaf_topk(spark, d):
    return _leaves(spark, d)


@query(
    "chunk_auto_merge",
    f"""{_LEAF}, t AS (SELECT query_id, CASE WHEN p.chunk_id IS NOT NULL THEN p.chunk_id ELSE c.chunk_id END AS target, min(rank) AS "at" FROM leaf JOIN chunk_orag_chunks c USING (chunk_id) LEFT JOIN chunk_orag_chunks p ON p.chunk_id = c.parent_id GROUP BY ALL)
    SELECT query_id, target AS chunk_id, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY "at")::INT AS rank FROM t) JOIN chunk_orag_chunks ON chunk_id = target WHERE rank <= 6""",
)
def chunk_auto_merge(spark, d):
    return chunks.merged(_leaves(spark, d), table(spark, d, "chunk_orag_chunks"), "query_id")


_MENTION = "coalesce(nullif(trim(m.trigger_word), ''), nullif(trim(m.text), ''), nullif(trim(m.name), ''))"


@query(
    "query_builder",
    f"""WITH {LATEST} SELECT document_id, array_to_string(list_filter(list_concat([title, CASE WHEN len(sentences) > 0 THEN array_to_string(sentences[1:3], chr(10)) ELSE substr(text, 1, 800) END],
      coalesce(list_filter(list_transform(list_transform(map_values(entities), lambda e: e.mentions[1]), lambda m: {_MENTION}), lambda t: t IS NOT NULL)[1:6], [])), lambda t: t IS NOT NULL AND t <> ''), chr(10)) AS query FROM docs""",
)
def query_builder(spark, d):
    return documents(spark, d).select("document_id", chunks.query_text().alias("query"))


@query("ontology_search")
def ontology_search(spark, d):
    """Concepts for the labels of the reference list, by weighted fuzzy ratios."""
    labels = table(spark, d, "canon_entries").select(F.col("entry_id").alias("query_id"), F.col("label").alias("query"))
    return ontology.search(labels, table(spark, d, "ontology_concepts"))


_ENTITY = f"""WITH {LATEST}, each AS (SELECT document_id, sentences, unnest(map_entries(entities)) AS x FROM docs), first AS (SELECT document_id, sentences, x.key AS entity_id, x.value.type AS type, x.value.mentions[1] AS m FROM each),
  texts AS (SELECT document_id, entity_id, concat_ws(' ; ', CASE WHEN {_MENTION} IS NOT NULL THEN 'event trigger: ' || {_MENTION} END, CASE WHEN trim(type) <> '' THEN 'event type: ' || type END,
    CASE WHEN trim(sentences[coalesce(m.sent_id, m.sentence_id) + 1]) <> '' THEN 'context: ' || sentences[coalesce(m.sent_id, m.sentence_id) + 1] END) AS text FROM first)"""


@query("entity_texts", f"{_ENTITY} SELECT * FROM texts")
def entity_texts(spark, d):
    return ontology.entity_texts(documents(spark, d)).drop("pos")


@query(
    "link_topk",
    f"""{_ENTITY}, cs AS (SELECT uri, label, concat_ws(' ', label, array_to_string(coalesce(aliases, []), ' '), description) AS text FROM ontology_concepts),
    t AS (SELECT document_id || chr(1) || entity_id AS id, document_id, entity_id, text FROM texts), {vectors_sql('e', 't', 'id')}, {vectors_sql('c', 'cs', 'uri')},
    dots AS (SELECT e.id, c.id AS uri, round(sum(e.weight * c.weight), 9) AS score FROM e JOIN c USING (bucket) GROUP BY ALL HAVING round(sum(e.weight * c.weight), 9) >= 0.3),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, uri)::INT AS rank FROM dots)
    SELECT document_id, entity_id, rank, uri AS concept_uri, label, score FROM r JOIN t USING (id) JOIN cs USING (uri) WHERE rank <= 3""",
)
def link_topk(spark, d):
    return ontology.link(ontology.entity_texts(documents(spark, d)), table(spark, d, "ontology_concepts"))


@query("links_nested")
def links_nested(spark, d):
    linked = ontology.link(ontology.entity_texts(documents(spark, d)), table(spark, d, "ontology_concepts"))
    return ontology.links_v1(linked).selectExpr("document_id", "to_json(ontology_links.by_entity) AS by_entity")


_TARGETS = f"""WITH {LATEST}, b AS (SELECT document_id, unnest(map_values(ontology_links.by_entity)) AS v FROM docs), c AS (SELECT document_id, unnest(v.candidates) AS c FROM b),
  targets AS (SELECT DISTINCT document_id, CASE WHEN lower(coalesce(nullif(c.target_kind, ''), 'class')) = 'datatype' THEN 'datatype' ELSE 'class' END AS kind, c.concept_uri AS uri
    FROM c WHERE c.concept_uri <> '' AND lower(coalesce(nullif(c.target_kind, ''), 'class')) <> 'property')"""


@query("link_targets", f"{_TARGETS} SELECT * FROM targets")
def link_targets(spark, d):
    return ontology.targets(documents(spark, d))


def rdf(spark, d):
    """The triples of the ontology, parsed from its top chunks."""
    return turtle.triples(table(spark, d, "chunk_orag_chunks").where("level = 0"), "text").distinct()


@query("rdf_triples")
def rdf_triples(spark, d):
    return rdf(spark, d)


@query("rdf_concepts")
def rdf_concepts(spark, d):
    return turtle.concepts(rdf(spark, d))


_KINDS = """n AS (SELECT uri, label, (row_number() OVER (ORDER BY uri) - 1) AS i, count(*) OVER () AS k FROM ontology_concepts),
  dom AS (SELECT a.uri, a.label, b.uri AS target FROM n a JOIN n b ON b.i = (a.i * 7 + 3) % a.k WHERE a.i % 2 = 0), rng AS (SELECT a.uri, a.label, b.uri AS target FROM n a JOIN n b ON b.i = (a.i * 11 + 5) % a.k WHERE a.i % 3 = 0)"""


def stand_in(spark, d):
    """Concepts taken for properties: every second has a domain, every third a range among the others, by their place in order of uri;
    the table is fixed, so its one ordered pass is bounded."""
    from pyspark.sql import Window

    n = table(spark, d, "ontology_concepts").select("uri", "label", (F.row_number().over(Window.orderBy("uri")) - 1).alias("i"))
    k = n.agg(F.count("*").alias("k"))
    a, b = n.join(k), n.select(F.col("uri").alias("o"), F.col("i").alias("j"))
    side = lambda p, step, x, y: a.where(F.col("i") % step == 0).join(b, (F.col("i") * x + y) % F.col("k") == F.col("j")).select(F.col("uri").alias("s"), F.lit(f"{turtle.RDFS}{p}").alias("p"), "o", F.lit(True).alias("o_is_iri"))
    names = n.select(F.col("uri").alias("s"), F.lit(f"{turtle.RDFS}label").alias("p"), F.col("label").alias("o"), F.lit(False).alias("o_is_iri"))
    return side("domain", 2, 7, 3).unionAll(side("range", 3, 11, 5)).unionAll(names)


@query(
    "subontology",
    f"""{_TARGETS}, {_KINDS}, props AS (SELECT uri, any_value(label) AS label FROM (SELECT uri, label FROM dom UNION ALL SELECT uri, label FROM rng) GROUP BY uri),
    docs_t AS (SELECT DISTINCT document_id FROM targets), dm AS (SELECT t.document_id, d.uri, d.target FROM dom d JOIN targets t ON t.uri = d.target AND t.kind = 'class'), rm AS (SELECT DISTINCT t.document_id, r.uri, r.target FROM rng r JOIN targets t ON t.uri = r.target)
    SELECT document_id, uri, label, domain, range, kept_because FROM (SELECT d.document_id, p.uri, p.label, (SELECT min(target) FROM dm WHERE dm.document_id = d.document_id AND dm.uri = p.uri) AS domain,
      (SELECT min(target) FROM rm WHERE rm.document_id = d.document_id AND rm.uri = p.uri) AS range, p.uri IN (SELECT uri FROM dom) AS hd, p.uri IN (SELECT uri FROM rng) AS hr,
      CASE WHEN p.uri IN (SELECT uri FROM dom) AND p.uri IN (SELECT uri FROM rng) THEN 'domain_and_range_match' WHEN p.uri IN (SELECT uri FROM dom) THEN 'domain_match_range_open' ELSE 'range_match_domain_open' END AS kept_because
      FROM docs_t d, props p) WHERE (NOT hd OR domain IS NOT NULL) AND (NOT hr OR range IS NOT NULL)""",
)
def subontology(spark, d):
    p = ontology.properties(stand_in(spark, d), ontology.targets(documents(spark, d)))
    return p.select("document_id", "uri", "label", F.get("domains", F.lit(0)).alias("domain"), F.get("ranges", F.lit(0)).alias("range"), "kept_because")


@query("subontology_turtle")
def subontology_turtle(spark, d):
    r = rdf(spark, d)
    wanted = ontology.targets(documents(spark, d))
    labels = r.where(f"p = '{turtle.RDFS}label'").groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label"))
    return ontology.turtle(ontology.fragment(ontology.properties(r, wanted), wanted, labels))


_LINES = r"""lines AS (SELECT chunk_id, (i - 1)::INT AS line, ls[i] AS text FROM (SELECT chunk_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT chunk_id, string_split(text, chr(10)) AS ls FROM chunk_orag_chunks WHERE level = 0)))"""


@query("ttl_line_index", f"""WITH {_LINES} SELECT DISTINCT chunk_id, line, unnest(regexp_extract_all(text, '<([^>\\s]+)>', 1)) AS uri FROM lines""")
def ttl_line_index(spark, d):
    return turtle.line_index(turtle.lines(table(spark, d, "chunk_orag_chunks").where("level = 0"), "chunk_id", "text"), "chunk_id")


@query("ttl_context")
def ttl_context(spark, d):
    """Line context of each document's links, lines being numbered over all chunks."""
    ls = turtle.lines(table(spark, d, "chunk_orag_chunks").where("level = 0"), "chunk_id", "text").withColumn("line", F.col("chunk_id") * 100_000 + F.col("line"))
    return ontology.line_context(documents(spark, d), ls.select("line", "text"), turtle.line_index(ls, "chunk_id").select("uri", "line"))
