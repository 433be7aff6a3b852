"""Queries over shredded documents."""

from __future__ import annotations

from braidwork.operators import shredding
from braidwork.plans.registry import query
from braidwork.sources.tables import table


@query(
    "p1_found",
    """
    WITH e AS (SELECT row_id, entities, unnest(map_entries(entities)) AS x FROM re_documents),
    r AS (SELECT row_id, entities, unnest(map_entries(relations)) AS x FROM re_documents),
    p AS (SELECT row_id, entities, x.key || '#' || (i - 1) AS k, x.value[i] AS w
          FROM (SELECT *, unnest(range(1, len(x.value) + 1)) AS i FROM r)
          WHERE len(x.value[i]) = 2 AND x.value[i][1] IS NOT NULL AND x.value[i][2] IS NOT NULL),
    b AS (SELECT row_id, entities, unnest(map_entries(ontology_links.by_entity)) AS x FROM re_documents),
    c AS (SELECT *, unnest(range(1, len(x.value.candidates) + 1)) AS i FROM b)
    SELECT row_id, 'entity' AS child_table, x.key AS child_key FROM e
    UNION ALL SELECT row_id, 'mention', x.key || '#' || (i - 1)
      FROM (SELECT *, unnest(range(1, len(x.value.mentions) + 1)) AS i FROM e) WHERE x.value.mentions[i] IS NOT NULL
    UNION ALL SELECT row_id, 'relation', k FROM p
    UNION ALL SELECT row_id, CASE WHEN coalesce(list_contains(map_keys(entities), w[1]), false) THEN 'endpoint' ELSE 'orphan_endpoint' END, k || '#h' FROM p
    UNION ALL SELECT row_id, CASE WHEN coalesce(list_contains(map_keys(entities), w[2]), false) THEN 'endpoint' ELSE 'orphan_endpoint' END, k || '#t' FROM p
    UNION ALL SELECT row_id, CASE WHEN coalesce(list_contains(map_keys(entities), x.key), false) THEN 'candidate' ELSE 'orphan_candidate' END, x.key || '#' || (i - 1)
      FROM c WHERE x.value.candidates[i] IS NOT NULL
    UNION ALL SELECT row_id, 'selected', x.key FROM b WHERE x.value.selected IS NOT NULL
    """,
)
def p1_found(spark, d):
    return shredding.found_children(table(spark, d, "re_documents"))


@query(
    "p1_mentions",
    """
    SELECT row_id, (e - 1)::INT AS entity_pos, map_keys(entities)[e] AS entity, (i - 1)::INT AS mention_pos, m IS NOT NULL AS present, m.id AS id, m.trigger_word AS trigger_word, m.sent_id AS sent_id
    FROM (SELECT row_id, entities, e, i, map_values(entities)[e].mentions[i] AS m
          FROM (SELECT row_id, entities, e, unnest(range(1, len(map_values(entities)[e].mentions) + 1)) AS i
                FROM (SELECT row_id, entities, unnest(range(1, len(map_keys(entities)) + 1)) AS e FROM re_documents)))
    """,
)
def p1_mentions(spark, d):
    t = shredding.child_tables(table(spark, d, "re_documents"), "row_id", "entities")["entities.value.mentions"]
    return t.selectExpr("row_id", "pos_1 AS entity_pos", "key_1 AS entity", "pos_2 AS mention_pos", "present", "leaf_id AS id", "leaf_trigger_word AS trigger_word", "leaf_sent_id AS sent_id")


@query(
    "p1_relations",
    """
    SELECT row_id, (j - 1)::INT AS relation_pos, k AS relation, (i - 1)::INT AS pair_pos, (e - 1)::INT AS end_pos, w IS NOT NULL AS present, w AS value
    FROM (SELECT row_id, j, k, i, e, v[i][e] AS w FROM (SELECT row_id, j, k, v, i, unnest(range(1, len(v[i]) + 1)) AS e
      FROM (SELECT row_id, j, k, v, unnest(range(1, len(v) + 1)) AS i FROM (SELECT row_id, j, map_keys(relations)[j] AS k, map_values(relations)[j] AS v
        FROM (SELECT row_id, relations, unnest(range(1, len(map_keys(relations)) + 1)) AS j FROM re_documents)))))
    """,
)
def p1_relations(spark, d):
    """Every end of every pair of the relations, malformed pairs included."""
    t = shredding.child_tables(table(spark, d, "re_documents"), "row_id", "relations")["relations.value.element"]
    return t.selectExpr("row_id", "pos_1 AS relation_pos", "key_1 AS relation", "pos_2 AS pair_pos", "pos_3 AS end_pos", "present", "leaf_value AS value")


@query(
    "p1_candidates",
    """
    SELECT row_id, (e - 1)::INT AS entity_pos, k AS entity, (i - 1)::INT AS candidate_pos, c IS NOT NULL AS present, c.concept_uri AS concept_uri, c.score AS score
    FROM (SELECT row_id, e, k, i, v.candidates[i] AS c FROM (SELECT row_id, e, k, v, unnest(range(1, len(v.candidates) + 1)) AS i
      FROM (SELECT row_id, e, map_keys(m)[e] AS k, map_values(m)[e] AS v FROM (SELECT row_id, m, unnest(range(1, len(map_keys(m)) + 1)) AS e FROM (SELECT row_id, ontology_links.by_entity AS m FROM re_documents)))))
    """,
)
def p1_candidates(spark, d):
    """Every candidate of the ontology links."""
    t = shredding.child_tables(table(spark, d, "re_documents"), "row_id", "ontology_links")["ontology_links.by_entity.value.candidates"]
    return t.selectExpr("row_id", "pos_1 AS entity_pos", "key_1 AS entity", "pos_2 AS candidate_pos", "present", "leaf_concept_uri AS concept_uri", "leaf_score AS score")
