"""Queries over model answers, prompts and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import answers
from braidwork.functions import text as txt
from braidwork.operators import filters, graph, ontology, relations, strategies
from braidwork.plans import contexts
from braidwork.plans.evaluation import LATEST, LONG, documents
from braidwork.plans.graphs import EDGES
from braidwork.plans.registry import query
from braidwork.plans.retrieval import words_sql
from braidwork.sources.tables import table


@query("claim_label", "SELECT doc_id, coalesce(nullif(regexp_extract(t, '\\b(SUPPORTS|REFUTES|NOT_ENOUGH_INFO)\\b', 1), ''), 'NOT_ENOUGH_INFO') AS label FROM (SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'It REFUTES ' WHEN 1 THEN 'SUPPORTS: ' ELSE 'unclear ' END, coalesce(text, '')) AS t FROM documents)")
def claim_label(spark, d):
    t = F.concat(F.when(F.col("doc_id") % 3 == 0, "It REFUTES ").when(F.col("doc_id") % 3 == 1, "SUPPORTS: ").otherwise("unclear "), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", txt.claim_label(t).alias("label"))


@query("truncate_context", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || chr(10) || '... (truncated)' ELSE text END AS context FROM documents")
def truncate_context(spark, d):
    return table(spark, d, "documents").select("doc_id", txt.truncated("text", 500).alias("context"))


@query("json_first", "SELECT pred_id, json(raw_json)::VARCHAR AS value FROM esl_predictions")
def json_first(spark, d):
    """The first JSON value in answers wrapped in prose and fences."""
    raw = F.concat(F.lit("Here {is} it: ```json\n"), "raw_json", F.lit("\n``` done"))
    return table(spark, d, "esl_predictions").select("pred_id", answers.first_json(raw).alias("value"))


@query("json_object_fields", "SELECT pred_id, json_extract_string(raw_json, '$.relation_type') AS relation_type FROM esl_predictions WHERE json_valid(raw_json)")
def json_object_fields(spark, d):
    raw = F.concat(F.lit("```json\n"), "raw_json", F.lit("\n```"))
    return table(spark, d, "esl_predictions").select("pred_id", F.get_json_object(answers.json_object(raw), "$.relation_type").alias("relation_type"), F.col("raw_json")).where("raw_json IS NOT NULL").drop("raw_json")


_TYPES = ["CAUSE", "PRECONDITION", "P828 : has cause"]
_NORMAL = f"""WITH {LATEST}, n AS (SELECT document_id, unnest({_TYPES!r}) AS rel, pred_relations AS m FROM docs WHERE pred_relations IS NOT NULL)
  SELECT document_id, rel, len(list_filter(coalesce(m[rel], []), lambda p: len(p) = 2 AND p[1] IS NOT NULL AND p[2] IS NOT NULL))::INT AS pairs FROM n"""


@query("normalise_relations", _NORMAL)
def normalise_relations(spark, d):
    docs = documents(spark, d).where("pred_relations IS NOT NULL")
    m = answers.normalised(answers.relations(F.to_json("pred_relations")), F.array(*map(F.lit, _TYPES)))
    return docs.select("document_id", F.explode(m).alias("rel", "p")).select("document_id", "rel", F.size("p").alias("pairs"))


@query(
    "alias_relations",
    f"""WITH {LATEST}, n AS (SELECT document_id, unnest({_TYPES!r}) AS rel, pred_relations AS m FROM docs WHERE pred_relations IS NOT NULL)
    SELECT document_id, rel, len(list_filter(coalesce(m[rel], []), lambda p: len(p) = 2 AND p[1] IS NOT NULL AND p[2] IS NOT NULL))::INT AS pairs FROM n""",
)
def alias_relations(spark, d):
    """Keys given by code or by label in capitals, mapped back to the full form."""
    docs = documents(spark, d).where("pred_relations IS NOT NULL")
    half = F.transform_keys("pred_relations", lambda k, v: F.when(F.col("row_id") % 2 == 0, F.split_part(k, F.lit(" :"), F.lit(1))).otherwise(F.upper(F.trim(F.substring_index(k, ":", -1)))))
    m = answers.by_alias(answers.relations(F.to_json(half)), F.array(*map(F.lit, _TYPES)))
    return docs.select("document_id", F.explode(m).alias("rel", "p")).select("document_id", "rel", F.size("p").alias("pairs"))


_KEY = lambda x: f"nullif(trim(regexp_replace(lower({x}), '[\\s\\x0b\\x85\\p{{Z}}]+', ' ', 'g')), '')"
_IDS = ", ids AS (SELECT document_id, unnest(map_keys(entities)) AS id FROM docs), ms AS (SELECT document_id, e.key AS entity_id, unnest(e.value.mentions) AS m FROM (SELECT document_id, unnest(map_entries(entities)) AS e FROM docs))"
_NAMED = f""", keyed AS (SELECT DISTINCT document_id, entity_id, {_KEY('t')} AS key FROM (SELECT document_id, entity_id, unnest([m.trigger_word, m.text]) AS t FROM ms)),
  named AS (SELECT document_id, key, min(entity_id) AS entity_id FROM keyed WHERE key IS NOT NULL GROUP BY ALL HAVING count(*) = 1)"""


@query("mention_unambiguous", f"WITH {LATEST}{_IDS}{_NAMED} SELECT document_id, key, entity_id FROM named")
def mention_unambiguous(spark, d):
    return answers.unambiguous(documents(spark, d))


def _ends(spark, d, variant):
    docs = documents(spark, d)
    return answers.ends(relations.triples(docs, "pred_relations"), docs, variant)


@query("ends_both", f"{LONG}{_IDS} SELECT * FROM pred p WHERE (document_id, head) IN (SELECT document_id, id FROM ids) AND (document_id, tail) IN (SELECT document_id, id FROM ids)")
def ends_both(spark, d):
    return _ends(spark, d, "both_in_set")


@query(
    "ends_strict",
    f"""{LONG}{_IDS}{_NAMED} SELECT * FROM (SELECT p.document_id, p.rel, p.pos, p.head, coalesce(i.id, n.entity_id) AS tail FROM pred p LEFT JOIN (SELECT DISTINCT * FROM ids) i ON i.document_id = p.document_id AND i.id = p.tail
      LEFT JOIN named n ON n.document_id = p.document_id AND n.key = {_KEY('p.tail')} WHERE (p.document_id, p.head) IN (SELECT document_id, id FROM ids)) WHERE tail IS NOT NULL""",
)
def ends_strict(spark, d):
    return _ends(spark, d, "strict_tail_literal")


_SURFACE = f""", es AS (SELECT document_id, p, map_keys(entities)[p] AS entity_id, map_values(entities)[p].mentions AS ms FROM (SELECT document_id, entities, unnest(range(1, len(map_keys(entities)) + 1)) AS p FROM docs)),
  first AS (SELECT document_id, p, entity_id, {_KEY("list_filter(list_transform(ms, lambda m: coalesce(nullif(trim(m.trigger_word), ''), nullif(trim(m.text), ''), nullif(trim(m.name), ''))), lambda t: t IS NOT NULL)[1]")} AS key FROM es),
  surf AS (SELECT document_id, key, arg_min(entity_id, p) AS entity_id FROM first WHERE key IS NOT NULL GROUP BY ALL)"""
_PICK = lambda c: f"coalesce((SELECT min(s.entity_id) FROM surf s WHERE s.document_id = p.document_id AND s.entity_id = trim(p.{c})), (SELECT s.entity_id FROM surf s WHERE s.document_id = p.document_id AND s.key = {_KEY('p.' + c)}))"


@query("ends_surface", f"{LONG}{_SURFACE} SELECT * FROM (SELECT document_id, rel, pos, {_PICK('head')} AS head, {_PICK('tail')} AS tail FROM pred p) WHERE head IS NOT NULL AND tail IS NOT NULL AND head <> tail")
def ends_surface(spark, d):
    return _ends(spark, d, "surface_first")


@query("ends_keep", f"{LONG} SELECT document_id, rel, pos, trim(head) AS head, trim(tail) AS tail FROM pred WHERE trim(head) <> '' AND trim(tail) <> ''")
def ends_keep(spark, d):
    return _ends(spark, d, "keep_unresolved")


_NAMES = "list_distinct(list_filter(list_transform(x.value.mentions, lambda m: coalesce(nullif(m.trigger_word, ''), nullif(m.text, ''))), lambda t: t IS NOT NULL))"


@query("prompt_entities", f"""WITH {LATEST}, e AS (SELECT document_id, map_keys(entities) AS ks, map_entries(entities) AS es FROM docs), l AS (SELECT document_id, i, es[i] AS x FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i FROM e)),
  n AS (SELECT document_id, i, x, list_filter(list_transform(x.value.mentions, lambda m: coalesce(nullif(m.trigger_word, ''), nullif(m.text, ''))), lambda t: t IS NOT NULL) AS names FROM l),
  t AS (SELECT document_id, i, concat('- ', x.key, ': "', CASE WHEN len(names) > 0 THEN array_to_string(list_filter(names, lambda v, j: list_position(names, v) = j), ', ') ELSE x.key END, '"', CASE WHEN x.value.type <> '' THEN ' [' || x.value.type || ']' ELSE '' END) AS line FROM n)
  SELECT document_id, coalesce(string_agg(line, chr(10) ORDER BY i), '(no entities provided)') AS lines FROM docs LEFT JOIN t USING (document_id) GROUP BY document_id""")
def prompt_entities(spark, d):
    return documents(spark, d).select("document_id", strategies.entity_lines().alias("lines"))


@query("token_count", f"""WITH {LATEST} SELECT document_id, CASE WHEN n > 0 THEN n ELSE len({words_sql("concat_ws(' ', text, title, array_to_string(sentences, ' '))")}) END::INT AS tokens
  FROM (SELECT *, coalesce(list_sum(list_transform(tokens, lambda t: coalesce(len(t), 0))), 0)::INT AS n FROM docs)""")
def token_count(spark, d):
    return documents(spark, d).select("document_id", txt.token_count("tokens", "text", "title", "sentences").alias("tokens"))


@query("rule_plan", f"""WITH {LATEST} SELECT document_id, u AS do_web, false AS do_wikidata FROM (SELECT document_id, coalesce(len(map_keys(entities)), 0) >= 8 AND (length(coalesce(text, '')) > 1200 OR coalesce(len(sentences), 0) > 9) AS u FROM docs)""")
def rule_plan(spark, d):
    return documents(spark, d).select("document_id", *(c.alias(n) for n, c in strategies.rule_plan(sentences=9, web=True).items()))


_EVENTS = f"""WITH {LATEST}, m AS (SELECT document_id AS doc_id, x.key AS event_id, x.value.type AS kind, x.value.mentions[1] AS m FROM (SELECT document_id, unnest(map_entries(entities)) AS x FROM docs)),
  ev AS (SELECT doc_id, event_id, kind AS lemma, coalesce(m.sent_id, m.sentence_id) AS sentence, coalesce(m.sent_id, m.sentence_id) * 1000 + coalesce(m.offset[1], 0) AS pos FROM m WHERE coalesce(m.sent_id, m.sentence_id) IS NOT NULL)"""


def events(spark, d):
    """First mentions of the entities as events with sentence and place."""
    m = documents(spark, d).select(F.col("document_id").alias("doc_id"), F.explode("entities").alias("event_id", "e")).select("doc_id", "event_id", F.col("e.type").alias("lemma"), F.get(F.col("e.mentions"), F.lit(0)).alias("m"))
    sent = F.coalesce("m.sent_id", "m.sentence_id")
    return m.select("doc_id", "event_id", "lemma", sent.alias("sentence"), (sent * 1000 + F.coalesce(F.get(F.col("m.offset"), F.lit(0)), F.lit(0))).alias("pos"), F.lit(None).cast("string").alias("event_class")).where("sentence IS NOT NULL")


@query("same_sentence_pairs", f"{_EVENTS} SELECT a.doc_id, a.event_id AS source, b.event_id AS target, 'PRECONDITION' AS relation FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.sentence = b.sentence AND a.pos < b.pos")
def same_sentence_pairs(spark, d):
    return strategies.same_sentence(events(spark, d))


_PAIRS = f"{_EVENTS}, pairs AS (SELECT a.lemma AS a, b.lemma AS b, count(*) AS n FROM ev a JOIN ev b ON a.doc_id = b.doc_id AND a.pos < b.pos WHERE a.lemma IS NOT NULL AND b.lemma IS NOT NULL GROUP BY ALL)"


@query("cooccurrence_pairs", f"{_PAIRS} SELECT * FROM pairs")
def cooccurrence_pairs(spark, d):
    return strategies.cooccurrences(events(spark, d).where("lemma IS NOT NULL"))


@query(
    "ppmi_pairs",
    f"""{_PAIRS}, s AS (SELECT a, b, n, greatest(0.0, log2(n * (sum(n) OVER ()) / ((sum(n) OVER (PARTITION BY a)) * (sum(n) OVER (PARTITION BY b))))) AS ppmi FROM pairs), e AS (SELECT min(ppmi) AS lo, max(ppmi) AS hi FROM s)
    SELECT a, b, n, round(ppmi, 6) AS ppmi, round((ppmi - lo) / (hi - lo), 6) AS scaled FROM s, e WHERE (ppmi - lo) / (hi - lo) BETWEEN 0.4 AND 0.763""",
)
def ppmi_pairs(spark, d):
    return strategies.ppmi(strategies.cooccurrences(events(spark, d).where("lemma IS NOT NULL"))).withColumns({c: F.round(c, 6) for c in ("ppmi", "scaled")})


@query("strategy_kg_echo", f"{LONG} SELECT DISTINCT document_id, rel, head, tail FROM gold")
def strategy_kg_echo(spark, d):
    """A whole strategy run with a model that answers with the gold it finds in its prompt: what comes out is the gold."""
    docs = documents(spark, d)
    gold = docs.select("document_id", F.concat(F.lit("GOLD"), F.to_json("relations"), F.lit("END")).alias("context")).where("context IS NOT NULL")
    out = strategies.run(docs, strategies.Strategy("echo", context="kg"), _gold, gold)
    return relations.triples(out, "pred_relations").select("document_id", "rel", "head", "tail").distinct()


def _gold(messages):
    body = messages[-1]["content"]
    return "```json\n" + body.partition("GOLD")[2].partition("END\nDocument:")[0].replace("END", "") + "\n```"


@query(
    "strategy_kg_context",
    f"""{EDGES}, h AS (SELECT s.document_id, row_number() OVER (PARTITION BY s.document_id ORDER BY s.pos, o) AS n, concat_ws(' ', '-', head, rel, tail) AS l FROM seeds s JOIN edges e ON s.node = e.head)
    SELECT document_id, string_agg(l, chr(10) ORDER BY n) AS context FROM h WHERE n <= 200 GROUP BY document_id""",
)
def strategy_kg_context(spark, d):
    """The context that the graph strategy puts into its prompt."""
    docs = documents(spark, d)
    return contexts.kg(docs, graph.gold_edges(docs))


@query("strategy_chunk_context")
def strategy_chunk_context(spark, d):
    return contexts.ontology_chunks(documents(spark, d), table(spark, d, "chunk_orag_chunks"))


@query("strategy_agent_context")
def strategy_agent_context(spark, d):
    docs = documents(spark, d)
    linked = ontology.link(ontology.entity_texts(docs), table(spark, d, "ontology_concepts"))
    return contexts.ontology_and_kg(docs, linked, graph.gold_edges(docs))


@query("strategy_few_shots", f"""WITH {LATEST}, s AS (SELECT row_id, concat_ws(chr(10), 'Example:', CASE WHEN regexp_matches(text, '[^\\s\\x0b\\x85\\p{{Z}}]') THEN text ELSE coalesce(array_to_string(sentences, ' '), '') END) AS l
  FROM (SELECT * FROM re_documents WHERE type = 'train' AND coalesce(len(list_filter(map_values(relations), lambda p: len(p) > 0)) > 0, false) ORDER BY row_id LIMIT 3)),
  c AS (SELECT string_agg(l, chr(10) ORDER BY row_id) AS context FROM s) SELECT document_id, md5(context) AS shots FROM docs, c""")
def strategy_few_shots(spark, d):
    """The examples of the few-shot strategy, as one hash for each document (their relations left out)."""
    every = table(spark, d, "re_documents")
    shots = filters.few_shots(every, 3, [F.col("row_id")], pool_first=False).withColumn("relations", F.lit(None).cast("string"))
    one = shots.select("row_id", F.concat_ws("\n", F.lit("Example:"), strategies.document_text()).alias("l"))
    text = one.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "l"))), lambda x: x["l"]), "\n").alias("t"))
    return documents(spark, d).select("document_id").join(F.broadcast(text)).select("document_id", F.md5("t").alias("shots"))


@query("pipeline_answers", "SELECT item_id AS task_id, 'claim_verification' AS task_type, 5::BIGINT AS n_evidence, '{\"label\":\"REFUTES\",\"rationale\":\"it says so\"}' AS output FROM eval_passages")
def pipeline_answers(spark, d):
    """Evaluation passages as claims against all documents, answered by a stand-in that always refutes."""
    from braidwork.plans.pipeline import Pipeline, dense

    docs = table(spark, d, "documents").selectExpr("doc_id AS id", "text")
    tasks = table(spark, d, "eval_passages").select(F.col("item_id").alias("task_id"), F.lit("claim_verification").alias("task_type"), F.col("text").alias("query"))
    run = Pipeline(strategies.fixed("It REFUTES this.\nRATIONALE: it says so"), dense(docs)).run(tasks)
    return run.select("task_id", "task_type", "n_evidence", "output")
