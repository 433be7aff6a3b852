"""Queries over stores, links in their nested form, contexts of strategies, and every strategy by its model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import embed, text as txt
from braidwork.operators import filters, graph, ontology, retrieve, store, strategies
from braidwork.plans import contexts
from braidwork.plans.answers import _EVENTS, events
from braidwork.plans.evaluation import LATEST, LONG, documents
from braidwork.plans.graphs import EDGES, there, triples
from braidwork.plans.ontologies import _ENTITY, _LINES, _MENTION
from braidwork.plans.registry import SQL, query
from braidwork.plans.retrieval import SPACE, concept_queries, vectors_sql
from braidwork.plans.roundtrips import folder
from braidwork.sources.tables import table

_CONCEPTS = "concat_ws(' ', label, array_to_string(coalesce(aliases, []), ' '))"


@query(
    "vector_store",
    f"""WITH stored AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 5 = 0 THEN 'replaced ' || coalesce(text, '') ELSE text END AS text FROM documents), asked AS (SELECT uri AS query_id, {_CONCEPTS} AS text FROM ontology_concepts),
    {vectors_sql('s', 'stored', 'id')}, {vectors_sql('q', 'asked', 'query_id')}, dots AS (SELECT q.id AS query_id, s.id, round(sum(s.weight * q.weight), 9) AS score FROM s JOIN q USING (bucket) GROUP BY ALL)
    SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM dots) WHERE rank <= 5""",
)
def vector_store(spark, d):
    """Documents stored with vectors, a fifth of them replaced by an upsert, and searched."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("document_id"), "text")
    held = store.VectorStore(spark, folder(spark))
    held.upsert(docs)
    held.upsert(docs.where("int(id) % 5 = 0").withColumn("text", F.concat(F.lit("replaced "), F.coalesce("text", F.lit("")))))
    return held.search(concept_queries(spark, d).select("query_id", F.col("query").alias("text")), 5).select("query_id", "id", "score", "rank")


@query("store_merges", f"SELECT CASE WHEN {there('rel')} THEN rel ELSE 'RELATED' END AS type, head AS source, tail AS target FROM kg_triples WHERE {there('head')} AND {there('tail')} GROUP BY ALL")
def store_merges(spark, d):
    """The edges that batches for a graph server hold."""
    batches = store.merge_batches(graph.upsert_edges(triples(spark, d)).select("head", "rel", "tail", "copies"), "edges", 500)
    rows = F.from_json("rows", "array<struct<source:string,type:string,target:string,properties:struct<copies:bigint>>>")
    return batches.select(F.explode(rows).alias("r")).select("r.type", "r.source", "r.target")


_LINKED = f"""{_ENTITY}, cs AS (SELECT uri, label, concat_ws(' ', label, array_to_string(coalesce(aliases, []), ' '), description) AS text FROM ontology_concepts),
    t AS (SELECT document_id || chr(1) || entity_id AS id, document_id, entity_id, text FROM texts), {vectors_sql('e', 't', 'id')}, {vectors_sql('c', 'cs', 'uri')},
    dots AS (SELECT e.id, c.id AS uri, round(sum(e.weight * c.weight), 9) AS score FROM e JOIN c USING (bucket) GROUP BY ALL HAVING round(sum(e.weight * c.weight), 9) >= 0.3),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, uri)::INT AS rank FROM dots)"""


def _linked(spark, d):
    return ontology.link(ontology.entity_texts(documents(spark, d)), table(spark, d, "ontology_concepts"))


@query("links_unnested", f"{_LINKED} SELECT document_id, entity_id, rank - 1 AS place, uri, label, score, '1.0' AS version FROM r JOIN t USING (id) JOIN cs USING (uri) WHERE rank <= 3")
def links_unnested(spark, d):
    """Links in their nested form, taken apart again."""
    n = ontology.links_v1(_linked(spark, d))
    each = n.select("document_id", F.col("ontology_links._meta.schema_version").alias("version"), F.explode("ontology_links.by_entity").alias("entity_id", "v"))
    return each.select("document_id", "entity_id", "version", F.posexplode("v.candidates").alias("place", "c")).select("document_id", "entity_id", "place", F.col("c.concept_uri").alias("uri"), "c.label", "c.score", "version")


@query("links_converted", f"{_LINKED} SELECT document_id, entity_id, rank - 1 AS place, uri, score FROM r JOIN t USING (id) WHERE rank <= 3")
def links_converted(spark, d):
    """Links in the nested form, brought to the old one and back."""
    n = ontology.upgrade(ontology.downgrade(ontology.links_v1(_linked(spark, d))))
    each = n.select("document_id", F.explode("ontology_links.by_entity").alias("entity_id", "v"))
    return each.select("document_id", "entity_id", F.posexplode("v.candidates").alias("place", "c")).select("document_id", "entity_id", "place", F.col("c.concept_uri").alias("uri"), "c.score")


@query("links_placeholder", f"WITH {LATEST} SELECT document_id, unnest(map_keys(entities)) AS entity_id, 0 AS candidates, 'not_implemented' AS note FROM docs")
def links_placeholder(spark, d):
    return ontology.empty_links(documents(spark, d)).select("document_id", "entity_id", F.size("candidates").alias("candidates"), "note")


@query("concept_evidence", f"""WITH asked AS (SELECT uri AS query_id, {_CONCEPTS} AS text FROM ontology_concepts), {vectors_sql('c', 'asked', 'query_id')}
  SELECT query_id, 1 AS rank, query_id AS document_id, regexp_replace(coalesce(label, '') || ': ' || coalesce(description, ''), ':\\s*$', '') AS text, 1.0::DOUBLE AS score FROM asked JOIN ontology_concepts ON uri = query_id WHERE query_id IN (SELECT id FROM c)""")
def concept_evidence(spark, d):
    """Concepts that are found exactly, as evidence."""
    c = table(spark, d, "ontology_concepts")
    found = concept_queries(spark, d).select("query_id", F.col("query_id").alias("uri"), F.lit(1).alias("rank"), F.lit("x").alias("label"), F.lit(1.0).alias("score"))
    return ontology.evidence(found, c.select("uri", "label", "description"))


@query(
    "two_stage_documents",
    f"""WITH e AS (SELECT * FROM kg_triples WHERE {there('head')} AND {there('tail')} AND sentence_id IS NOT NULL AND document_id IS NOT NULL), once AS (SELECT sentence_id, arg_min(document_id, (triple_id, document_id)) AS community, min(triple_id) AS pos FROM e GROUP BY sentence_id),
    said AS (SELECT sentence_id, arg_min(concat_ws(' ', head, rel, tail), triple_id) AS text FROM e GROUP BY sentence_id), asked AS (SELECT uri AS query_id, {_CONCEPTS} AS text FROM ontology_concepts),
    {vectors_sql('s', 'said', 'sentence_id')}, {vectors_sql('q', 'asked', 'query_id')}, size AS (SELECT community, count(*) AS n FROM once GROUP BY ALL),
    mean AS (SELECT community, bucket, sum(weight) / any_value(n) AS x FROM once JOIN size USING (community) JOIN s ON s.id = sentence_id GROUP BY community, bucket), norm AS (SELECT community, sqrt(sum(x * x)) AS norm FROM mean GROUP BY ALL),
    near AS (SELECT q.id AS query_id, community, round(sum(x * weight) / any_value(norm), 9) AS score FROM mean JOIN q USING (bucket) JOIN norm USING (community) GROUP BY q.id, community),
    chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, community) AS cr FROM near WHERE score <> 0),
    dots AS (SELECT q.id AS query_id, s.id AS sentence_id, sum(s.weight * q.weight) AS dot FROM s JOIN q USING (bucket) GROUP BY ALL),
    scored AS (SELECT c.query_id, o.sentence_id, c.community, round(coalesce(dot, 0), 9) AS score, cr, pos FROM chosen c JOIN once o USING (community) LEFT JOIN dots d ON d.query_id = c.query_id AND d.sentence_id = o.sentence_id WHERE cr <= 3)
    SELECT query_id, sentence_id, community, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cr, pos, sentence_id)::INT AS rank FROM scored) WHERE rank <= 10""",
)
def two_stage_documents(spark, d):
    """Sentences for concepts in two stages, a document's sentences taken for a community."""
    e = triples(spark, d).where(F.col("head").rlike(r"(?U)\S") & F.col("tail").rlike(r"(?U)\S") & F.col("sentence_id").isNotNull() & F.col("document_id").isNotNull())
    first = e.groupBy("sentence_id").agg(F.min(F.struct("edge_id", "document_id")).alias("m")).select("sentence_id", F.col("m.document_id").alias("community"), F.col("m.edge_id").alias("pos"))
    said = e.groupBy("sentence_id").agg(F.min_by(F.concat_ws(" ", "head", "rel", "tail"), "edge_id").alias("text"))
    return graph.two_stage(embed.embed(concept_queries(spark, d), "query"), first, embed.embed(said, "text"))


_CHUNK = f"""WITH {LATEST}, asked AS (SELECT document_id, array_to_string(list_filter(list_concat([title, CASE WHEN len(sentences) > 0 THEN array_to_string(sentences[1:3], chr(10)) ELSE substr(text, 1, 800) END],
      coalesce(list_filter(list_transform(list_transform(map_values(entities), lambda e: e.mentions[1]), lambda m: {_MENTION}), lambda t: t IS NOT NULL)[1:6], [])), lambda t: t IS NOT NULL AND t <> ''), chr(10)) AS text FROM docs),
    leaf AS (SELECT * FROM chunk_orag_chunks WHERE is_leaf = 1), {vectors_sql('q', 'asked', 'document_id')}, {vectors_sql('c', 'leaf', 'chunk_id')}, wanted AS (SELECT document_id FROM asked WHERE {there('text')}),
    dots AS (SELECT q.id AS document_id, c.id AS chunk_id, sum(q.weight * c.weight) AS dot FROM q JOIN c USING (bucket) GROUP BY ALL), every AS (SELECT document_id, chunk_id, round(coalesce(dot, 0), 9) AS score FROM wanted CROSS JOIN (SELECT chunk_id FROM leaf) LEFT JOIN dots USING (document_id, chunk_id)),
    best AS (SELECT document_id, chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, chunk_id) AS rank FROM every)"""
SQL["strategy_chunk_context"] = f"{_CHUNK} SELECT document_id, string_agg(coalesce(text, ''), chr(10) ORDER BY rank) AS context FROM best JOIN leaf USING (chunk_id) WHERE rank <= 8 GROUP BY document_id"
SQL["strategy_agent_context"] = f"""{_LINKED}, top AS (SELECT document_id, entity_id, label FROM r JOIN t USING (id) JOIN cs USING (uri) WHERE rank <= 3), said AS (SELECT document_id, string_agg(l, chr(10) ORDER BY l) AS c FROM (SELECT DISTINCT document_id, entity_id || ' is a ' || label AS l FROM top WHERE label IS NOT NULL) GROUP BY document_id),
    {EDGES.partition(', rels AS')[2].join(['rels AS', ''])}, h AS (SELECT s.document_id, row_number() OVER (PARTITION BY s.document_id ORDER BY s.pos, o) AS n, head, rel, tail FROM seeds s JOIN edges e ON s.node = e.head),
    f AS (SELECT document_id, concat_ws(' ', '-', head, rel, tail) AS l, row_number() OVER (PARTITION BY document_id ORDER BY min(n)) AS n FROM h GROUP BY document_id, head, rel, tail), g AS (SELECT document_id, string_agg(l, chr(10) ORDER BY n) AS t FROM f WHERE n <= 40 GROUP BY document_id)
    SELECT document_id, nullif(concat_ws(chr(10), c, t), '') AS context FROM docs LEFT JOIN said USING (document_id) LEFT JOIN g USING (document_id)"""


SQL["links_nested"] = f"""{_LINKED}, one AS (SELECT document_id, entity_id, list({{'target_kind': 'class', 'concept_uri': uri, 'label': label, 'score': score, 'source': 'embedding'}} ORDER BY score DESC, rank) AS candidates FROM r JOIN t USING (id) JOIN cs USING (uri) WHERE rank <= 3 GROUP BY ALL)
    SELECT document_id, to_json(map_from_entries(list((entity_id, {{'candidates': candidates}}) ORDER BY entity_id)))::VARCHAR AS by_entity FROM one GROUP BY document_id"""


@query("strategy_calls", f"""WITH {LATEST}, s AS (SELECT unnest({list(strategies.STRATEGIES)!r}) AS strategy) SELECT document_id, strategy, CASE WHEN strategy = 'grow_rag' AND ontology_links IS NULL THEN 0 WHEN strategy = 'cot' THEN 2 WHEN strategy = 'marag' THEN 3 ELSE 1 END::INT AS calls, 0::BIGINT AS pairs FROM docs, s""")
def strategy_calls(spark, d):
    """Every strategy with a model that finds nothing: its calls for each document, and no pair."""
    docs = documents(spark, d)
    gold = docs.select("document_id", F.lit("nothing known").alias("context"))
    out = None
    for name in strategies.STRATEGIES:
        one = strategies.run(docs, name, strategies.fixed("{}"), gold)
        one = one.select("document_id", F.lit(name).alias("strategy"), F.col("calls").cast("int").alias("calls"), F.aggregate(F.map_values("pred_relations"), F.lit(0).cast("bigint"), lambda a, x: a + F.size(x)).alias("pairs"))
        out = one if out is None else out.unionAll(one)
    return out


@query("reranked", f"""WITH asked AS (SELECT item_id, text FROM eval_passages), {vectors_sql('d', 'documents', 'doc_id')}, {vectors_sql('q', 'eval_passages', 'item_id')},
  dots AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.weight * d.weight), 9) AS score FROM d JOIN q USING (bucket) GROUP BY ALL), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM dots) WHERE rank <= 5)
  SELECT item_id, doc_id, new_rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY -abs(length(d.text) - length(q.text)) DESC, rank)::INT AS new_rank FROM f JOIN documents d USING (doc_id) JOIN asked q USING (item_id)) WHERE new_rank <= 3""")
def reranked(spark, d):
    """The best documents of passages, ranked again by a stand-in for a model that likes texts of the passage's length."""
    items, docs = table(spark, d, "eval_passages").select("item_id", F.col("text").alias("q")), table(spark, d, "documents").select("doc_id", F.col("text").alias("t"))
    best = retrieve.nearest(table(spark, d, "eval_passages"), table(spark, d, "documents"), "item_id", "doc_id", "text", 5)
    like = embed.pair_score("q", "t", lambda: lambda pairs: [-abs(len(t or "") - len(q or "")) for q, t in pairs])
    return retrieve.rerank(best.join(docs, "doc_id").join(items, "item_id"), like, ["item_id"], 3).select("item_id", "doc_id", "new_rank")


@query("contained_pairs", f"""{_EVENTS}, p AS (SELECT a.doc_id, a.event_id AS source, b.event_id AS target FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.pos < b.pos)
  SELECT DISTINCT p.* FROM p JOIN ev s ON s.doc_id = p.doc_id AND s.event_id = p.source JOIN ev t ON t.doc_id = p.doc_id AND t.event_id = p.target WHERE s.lemma = t.lemma""")
def contained_pairs(spark, d):
    """Pairs of a sentence whose events lie in one container, their type standing in for it."""
    e = events(spark, d)
    pairs = strategies.same_sentence(e).select("doc_id", "source", "target")
    return strategies.in_containers(pairs, e.select("doc_id", "event_id", F.col("lemma").alias("container")))


@query("pruned_types", f"""WITH {LATEST}, l AS (SELECT document_id, lower(concat_ws(' ', title, CASE WHEN {there('text')} THEN text WHEN sentences IS NOT NULL THEN array_to_string(sentences, ' ') ELSE '' END)) AS said FROM docs), ty AS (SELECT unnest(['P17 : country', 'P6 : head of government', 'flood_damage', 'pump failure', 'P1 : the']) AS r),
  s AS (SELECT document_id, r, CASE WHEN len(ws) > 0 THEN len(list_filter(ws, lambda w: contains(said, w))) + 0.05 * len(ws) ELSE 0 END AS s FROM l, (SELECT r, list_filter(regexp_extract_all(lower(CASE WHEN contains(r, ':') THEN r[instr(r, ':') + 1:] ELSE r END), '[a-z0-9]+'), lambda w: w NOT IN ('of', 'the', 'a', 'an', 'in', 'on', 'to', 'for', 'and', 'or')) AS ws FROM ty))
  SELECT document_id, string_agg(r, '|' ORDER BY s DESC, r DESC) AS types FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s DESC, r DESC) AS n FROM s) WHERE n <= 3 GROUP BY document_id""")
def pruned_types(spark, d):
    """Relation types by the words of their labels that a document says: the best three of five."""
    types = F.array(*map(F.lit, ["P17 : country", "P6 : head of government", "flood_damage", "pump failure", "P1 : the"]))
    return strategies.pruned_types(documents(spark, d).withColumn("types", types), 3, 2).select("document_id", F.array_join("prompt_types", "|").alias("types"))


@query("prompt_caps", f"""WITH {LATEST}, r AS (SELECT document_id, map_entries(relations) AS es FROM docs), l AS (SELECT document_id, j, es[j].key AS rel, list_filter(es[j].value, lambda p: len(p) = 2 AND p[1] IS NOT NULL AND p[2] IS NOT NULL)[1:2] AS ps FROM (SELECT *, unnest(range(1, len(es) + 1)) AS j FROM r)),
  p AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY j, i) AS n, concat_ws(' ', '-', ps[i][1], rel, ps[i][2]) AS line FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM l))
  SELECT document_id, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (n <= 5), '') AS lines, least(coalesce(len(map_keys(any_value(entities))), 0), 12)::INT AS entities FROM docs LEFT JOIN p USING (document_id) GROUP BY document_id""")
def prompt_caps(spark, d):
    """What a prompt shows of relations and entities under its caps."""
    shown = F.when(F.coalesce(F.size("entities"), F.lit(0)) > 0, F.size(F.split(strategies.entity_lines(12, 1), r"\n(?=- )"))).otherwise(0)
    return documents(spark, d).select("document_id", strategies.relation_lines("relations", 2, 5).alias("lines"), shown.alias("entities"))


_SOFT = "['the','a','an','of','to','in','on','at','for','from','with','and','or','but','by','is','are','was','were','be','been','being','this','that','it','she','he','they','them','her','his','their','its','as','into','over','under','out','up','down']"
_NORM = lambda x: f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\x0b\\x1c-\\x1f\\x85\\p{{Z}}]', ' ', 'g'), '{SPACE}', ' ', 'g'))"


@query("soft_words", f"SELECT pred_id, array_to_string(list_filter(string_split({_NORM('pred_source_span')}, ' '), lambda w: w <> '' AND NOT list_contains({_SOFT}, w)), ' ') AS words FROM esl_predictions")
def soft_words(spark, d):
    return table(spark, d, "esl_predictions").select("pred_id", F.array_join(txt.soft_tokens("pred_source_span"), " ").alias("words"))


_SET = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '{SPACE}'), lambda w: w <> ''))"


@query(
    "best_events",
    f"""WITH sp AS (SELECT pred_id AS span_id, doc_id, pred_source_span AS s FROM esl_predictions WHERE {there('pred_source_span')} AND doc_id IS NOT NULL), {LATEST},
    ev AS (SELECT document_id AS doc_id, ks[p] AS event_id, p AS pos, array_to_string([coalesce(nullif(trim(m.trigger_word), ''), nullif(trim(m.text), ''), nullif(trim(m.name), ''))], '') AS t FROM (SELECT document_id, map_keys(entities) AS ks, p, map_values(entities)[p].mentions[1] AS m FROM (SELECT document_id, entities, unnest(range(1, len(map_keys(entities)) + 1)) AS p FROM docs))),
    j AS (SELECT sp.doc_id, span_id, event_id, pos, CASE WHEN len({_SET('s')}) > 0 AND len({_SET('t')}) > 0 THEN len(list_intersect({_SET('s')}, {_SET('t')})) / len(list_distinct(list_concat({_SET('s')}, {_SET('t')}))) ELSE 0 END AS score FROM sp JOIN ev USING (doc_id))
    SELECT doc_id, span_id, event_id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, span_id ORDER BY score DESC, pos) AS n FROM j WHERE score >= 0.2) WHERE n = 1""",
)
def best_events(spark, d):
    """Typed spans against the events of their document by common words."""
    spans = table(spark, d, "esl_predictions").where(F.col("pred_source_span").rlike(r"(?U)\S") & F.col("doc_id").isNotNull()).select("doc_id", F.col("pred_id").alias("span_id"), F.col("pred_source_span").alias("span_text"))
    m = documents(spark, d).select(F.col("document_id").alias("doc_id"), F.posexplode("entities").alias("pos", "event_id", "e"))
    ev = m.select("doc_id", "event_id", "pos", F.coalesce(txt.mention_text(F.get(F.col("e.mentions"), F.lit(0))), F.lit("")).alias("event_text"))
    return retrieve.best_by_jaccard(spans, ev).withColumn("score", F.round("score", 9))


@query("text_forms", r"""SELECT pred_id, regexp_replace(split_part(t, ':', 1), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') AS relation, regexp_replace(trim(regexp_replace(t, '[^A-Za-z0-9.-]+', '_', 'g')), '^ +| +$', '', 'g') AS slug, strftime(predicted_at, '%Y-%m-%dT%H:%M:%S+00:00') AS at,
  array_to_string(list_filter(list_transform(string_split(pred_source_event_id, '_'), lambda p: TRY_CAST(p AS INT)), lambda p: p IS NOT NULL), ',') AS span FROM (SELECT *, coalesce(pred_relation_type, '') AS t FROM esl_predictions)""")
def text_forms(spark, d):
    t = F.coalesce("pred_relation_type", F.lit(""))
    return table(spark, d, "esl_predictions").select("pred_id", txt.canonical_relation(t).alias("relation"), txt.slug(t).alias("slug"), txt.iso_utc(F.col("predicted_at").cast("timestamp")).alias("at"), F.array_join(txt.span_ids("pred_source_event_id").cast("array<string>"), ",").alias("span"))


@query("default_types", f"WITH {LATEST} SELECT document_id, array_to_string(CASE WHEN len(map_keys(relations)) > 0 THEN map_keys(relations) ELSE ['causal_relation'] END, '|') AS types FROM docs")
def default_types(spark, d):
    return documents(spark, d).select("document_id", F.array_join(txt.relation_types(None, "relations"), "|").alias("types"))


@query("prediction_views", "SELECT row_id, document_id, title, text, type, dataset, NULL::BOOLEAN AS predicted FROM re_documents UNION ALL SELECT NULL, document_id, NULL, NULL, NULL, NULL, pred_relations IS NOT NULL FROM re_documents")
def prediction_views(spark, d):
    """The plain columns of documents, and the view of their predictions alone."""
    docs = table(spark, d, "re_documents")
    one = filters.primitive_columns(docs).select("row_id", "document_id", "title", "text", "type", "dataset", F.lit(None).cast("boolean").alias("predicted"))
    return one.unionByName(filters.prediction_view(docs).select("document_id", F.col("pred_relations").isNotNull().alias("predicted")), allowMissingColumns=True)


SQL["document_graphs"] = f"""{LONG}, ends AS (SELECT document_id, head AS id FROM gold UNION SELECT document_id, tail FROM gold), n AS (SELECT document_id, list({{'id': id, 'label': id}} ORDER BY id) AS nodes FROM ends GROUP BY ALL),
    e AS (SELECT document_id, list({{'source': head, 'target': tail, 'relation': rel}} ORDER BY head, tail, rel) AS edges FROM gold GROUP BY ALL)
    SELECT document_id, to_json({{'doc_id': document_id, 'nodes': nodes, 'edges': edges}})::VARCHAR AS graph FROM n JOIN e USING (document_id)"""
SQL["ttl_context"] = f"""WITH {LATEST}, {_LINES}, l AS (SELECT chunk_id * 100000 + line AS line, text FROM lines), ix AS (SELECT DISTINCT line, unnest(regexp_extract_all(text, '<([^>\\s]+)>', 1)) AS uri FROM l),
    each AS (SELECT document_id, x.key AS entity, i - 1 AS p, x.value.candidates[i].concept_uri AS uri FROM (SELECT document_id, x, unnest(range(1, least(len(x.value.candidates), 6) + 1)) AS i FROM (SELECT document_id, unnest(map_entries(ontology_links.by_entity)) AS x FROM docs))),
    uris AS (SELECT document_id, uri, min((entity, p)) AS a FROM each WHERE uri <> '' GROUP BY ALL), hits AS (SELECT document_id, a, ix.line AS hit, unnest(range(greatest(0, ix.line - 2), ix.line + 3)) AS line FROM uris JOIN ix USING (uri)),
    once AS (SELECT document_id, line, text, min((a, hit, line)) AS a FROM hits JOIN l USING (line) GROUP BY document_id, line, text),
    picked AS (SELECT *, regexp_matches(lower(text), 'label|comment|definition| rdf:type | a ') AS good, row_number() OVER (PARTITION BY document_id ORDER BY a) AS n FROM once),
    said AS (SELECT document_id, string_agg(text, chr(10) ORDER BY n) FILTER (good OR NOT any_good) AS found FROM (SELECT *, bool_or(good) OVER (PARTITION BY document_id) AS any_good FROM picked WHERE n <= 200) GROUP BY document_id)
    SELECT document_id, coalesce(found, CASE WHEN document_id IN (SELECT document_id FROM uris) THEN '{ontology.NO_LINES}' ELSE '{ontology.NO_LINKS}' END) AS context FROM docs LEFT JOIN said USING (document_id)"""


def communities_sql(source: str, rounds: int = 8) -> str:
    """Label propagation as so many tables: label{rounds} (node, community) of the edges of `source`."""
    out = [f"pairs AS (SELECT least(head, tail) AS a, greatest(head, tail) AS b, count(*) AS weight FROM {source} WHERE head <> tail GROUP BY ALL)", "both_ways AS (SELECT a, b, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs)", "label0 AS (SELECT DISTINCT a AS node, a AS community FROM both_ways)"]
    for k in range(rounds):
        out.append(f"vote{k} AS (SELECT node, community, sum(weight) AS w FROM (SELECT x.a AS node, community, weight FROM both_ways x JOIN label{k} l ON x.b = l.node UNION ALL SELECT node, community, 1 FROM label{k}) GROUP BY ALL)")
        out.append(f"label{k + 1} AS MATERIALIZED (SELECT node, arg_min(community, (-w, community)) AS community FROM vote{k} GROUP BY node)")
    return ", ".join(out)


SQL["kg_communities"] = f"WITH {communities_sql('kg_triples')} SELECT * FROM label8"
SQL["kg_two_stage"] = f"""WITH e AS (SELECT * FROM kg_triples WHERE trim(head) <> '' AND trim(tail) <> ''), {communities_sql('e')},
    placed AS (SELECT coalesce(h.community, t.community) AS community, sentence_id, triple_id FROM e LEFT JOIN label8 h ON h.node = e.head LEFT JOIN label8 t ON t.node = e.tail WHERE sentence_id IS NOT NULL),
    once AS (SELECT sentence_id, arg_min(community, (triple_id, community)) AS community, min(triple_id) AS pos FROM placed WHERE community IS NOT NULL GROUP BY sentence_id),
    {SQL['two_stage_documents'].partition("GROUP BY sentence_id), ")[0].partition("said AS")[1] or "said AS"}{SQL['two_stage_documents'].partition("said AS")[2]}""".replace("WHERE cr <= 3", "WHERE cr <= (SELECT greatest(1, ceil(0.01 * count(*) - 1e-9)) FROM size)")
