"""Queries that evaluate predicted relations of documents against gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import filters, relations
from braidwork.plans.registry import query
from braidwork.sources.tables import table

#: The latest delivery of each document.
LATEST = """docs AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS rn
   FROM re_documents WHERE document_id IS NOT NULL) WHERE rn = 1)"""


def long_sql(name: str, column: str) -> str:
    return f"""{name}_m AS (SELECT document_id, unnest(map_entries({column})) AS x FROM docs),
  {name} AS (SELECT document_id, x.key AS rel, (i - 1)::INT AS pos, x.value[i][1] AS head, x.value[i][2] AS tail
   FROM (SELECT *, unnest(range(1, len(x.value) + 1)) AS i FROM {name}_m) WHERE len(x.value[i]) = 2 AND x.value[i][1] IS NOT NULL AND x.value[i][2] IS NOT NULL)"""


LONG = f"WITH {LATEST}, {long_sql('gold', 'relations')}, {long_sql('pred', 'pred_relations')}"
MATCHED = LONG + """, matched AS (SELECT document_id, rel, head, tail, bool_or(g) AS in_gold, bool_or(NOT g) AS in_pred FROM (
   SELECT document_id, rel, head, tail, true AS g FROM gold UNION ALL SELECT document_id, rel, head, tail, false FROM pred) GROUP BY ALL)"""
COUNTS = "count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn, count(*) FILTER (in_gold) AS support_gold, count(*) FILTER (in_pred) AS support_pred"
SCORES = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1"
ROUND = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 9) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 9) AS f1"


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


def documents(spark, d):
    return filters.latest(table(spark, d, "re_documents"))


def gold_pred(spark, d):
    docs = documents(spark, d)
    return relations.triples(docs), relations.triples(docs, "pred_relations")


PRF = ("precision", "recall", "f1")


@query("eval_micro", f"{MATCHED} SELECT *, {ROUND} FROM (SELECT {COUNTS} FROM matched)")
def eval_micro(spark, d):
    return rounded(relations.micro(relations.matched(*gold_pred(spark, d))), *PRF)


@query("eval_per_relation", f"{MATCHED} SELECT *, {ROUND} FROM (SELECT rel, {COUNTS} FROM matched GROUP BY rel)")
def eval_per_relation(spark, d):
    return rounded(relations.per_relation(relations.matched(*gold_pred(spark, d))), *PRF)


@query("eval_rollup", f"{MATCHED} SELECT *, {ROUND} FROM (SELECT rel, grouping(rel) = 1 AS total, {COUNTS} FROM matched GROUP BY ROLLUP (rel))")
def eval_rollup(spark, d):
    return rounded(relations.rollup(relations.matched(*gold_pred(spark, d))), *PRF)


@query("eval_ignore_label", f"{MATCHED} SELECT *, {ROUND} FROM (SELECT {COUNTS} FROM matched WHERE rel NOT IN ('CAUSE', 'null'))")
def eval_ignore_label(spark, d):
    gold, pred = (filters.without_labels(x, ["CAUSE", "null"]) for x in gold_pred(spark, d))
    return rounded(relations.micro(relations.matched(gold, pred)), *PRF)


@query("eval_per_document", f"{MATCHED} SELECT *, {ROUND} FROM (SELECT document_id, {COUNTS} FROM matched GROUP BY document_id)")
def eval_per_document(spark, d):
    return rounded(relations.per_document(relations.matched(*gold_pred(spark, d))), *PRF)


@query(
    "eval_macro",
    f"""{MATCHED}, per AS (SELECT *, {SCORES} FROM (SELECT document_id, {COUNTS} FROM matched GROUP BY document_id))
    SELECT documents, round(mp, 9) AS macro_precision, round(mr, 9) AS macro_recall, round(mf, 9) AS macro_f1, tp, fp, fn,
      round(tp / (tp + fp), 9) AS micro_precision, round(tp / (tp + fn), 9) AS micro_recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS micro_f1
    FROM (SELECT count(*) AS documents, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM per)""",
)
def eval_macro(spark, d):
    out = relations.macro(relations.matched(*gold_pred(spark, d)))
    return rounded(out, *(f"{k}_{c}" for k in ("macro", "micro") for c in PRF))


_BINARY = "CASE WHEN upper(rel) IN ('PRECONDITION', 'CAUSE', 'RESULT', 'ENABLE', 'FALLING_ACTION', 'CAUSAL_RELATION') THEN 'CAUSAL' ELSE upper(rel) END"


@query(
    "eval_binary_labels",
    f"""{LONG}, matched AS (SELECT document_id, rel, head, tail, bool_or(g) AS in_gold, bool_or(NOT g) AS in_pred FROM (
      SELECT document_id, {_BINARY} AS rel, head, tail, true AS g FROM gold UNION ALL SELECT document_id, {_BINARY}, head, tail, false FROM pred) GROUP BY ALL)
    SELECT *, {ROUND} FROM (SELECT rel, {COUNTS} FROM matched GROUP BY rel)""",
)
def eval_binary_labels(spark, d):
    gold, pred = (x.withColumn("rel", relations.label("rel", "binary")) for x in gold_pred(spark, d))
    return rounded(relations.per_relation(relations.matched(gold, pred)), *PRF)


_SOFT = LONG + """, g AS (SELECT DISTINCT document_id, head, tail, upper(rel) AS lab FROM gold), p AS (SELECT DISTINCT document_id, head, tail, upper(rel) AS lab FROM pred),
  credited AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.document_id = p.document_id AND g.head = p.head AND g.tail = p.tail AND g.lab = p.lab) THEN 'exact'
    WHEN EXISTS (SELECT 1 FROM g WHERE g.document_id = p.document_id AND least(g.head, g.tail) = least(p.head, p.tail) AND greatest(g.head, g.tail) = greatest(p.head, p.tail)) THEN 'undirected'
    WHEN EXISTS (SELECT 1 FROM g WHERE g.document_id = p.document_id AND (g.head = p.head OR g.tail = p.tail)) THEN 'one_end' ELSE 'wrong' END AS match_kind FROM p),
  soft AS (SELECT *, CASE match_kind WHEN 'exact' THEN 1.0 WHEN 'undirected' THEN 0.75 WHEN 'one_end' THEN 0.5 ELSE 0.0 END::DOUBLE AS credit FROM credited)"""


@query("eval_soft_edges", f"{_SOFT} SELECT * FROM soft")
def eval_soft_edges(spark, d):
    return relations.soft_credit(*gold_pred(spark, d))


@query(
    "eval_soft_scores",
    f"""{_SOFT} SELECT *, round(credit / pred_edges, 9) AS soft_precision, round(credit / gold_edges, 9) AS soft_recall,
      round(2 * (credit / pred_edges) * (credit / gold_edges) / (credit / pred_edges + credit / gold_edges), 9) AS soft_f1
    FROM (SELECT (SELECT count(*) FROM g) AS gold_edges, (SELECT count(*) FROM p) AS pred_edges, (SELECT sum(credit) FROM soft) AS credit)""",
)
def eval_soft_scores(spark, d):
    gold, pred = gold_pred(spark, d)
    return rounded(relations.soft_scores(relations.soft_credit(gold, pred), gold), "soft_precision", "soft_recall", "soft_f1")


def _bag(by: str, missed: str) -> str:
    on = lambda a, b, cols: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols.split())
    return f"""{LONG} SELECT *, {ROUND} FROM (SELECT (SELECT count(*) FROM pred p WHERE EXISTS (SELECT 1 FROM gold g WHERE {on('g', 'p', by)})) AS tp,
      (SELECT count(*) FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE {on('g', 'p', by)})) AS fp,
      (SELECT count(*) FROM gold g WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE {on('g', 'p', missed)})) AS fn)"""


@query("eval_bag_pairs", _bag("document_id head tail", "document_id head tail"))
def eval_bag_pairs(spark, d):
    return rounded(relations.bag_scores(*gold_pred(spark, d), with_label=False), *PRF)


@query("eval_bag_labels", _bag("document_id head tail rel", "document_id head tail rel"))
def eval_bag_labels(spark, d):
    return rounded(relations.bag_scores(*gold_pred(spark, d), with_label=True), *PRF)


@query("eval_bag_labels_compatible", _bag("document_id head tail rel", "document_id head tail"))
def eval_bag_labels_compatible(spark, d):
    return rounded(relations.bag_scores(*gold_pred(spark, d), with_label=True, compatible=True), *PRF)


@query(
    "eval_missing_gold",
    f"""WITH {LATEST}, pred AS (SELECT document_id, CASE WHEN dataset = 'causalbank' THEN NULL ELSE relations END AS own FROM docs WHERE pred_relations IS NOT NULL),
    g AS (SELECT document_id, relations FROM docs WHERE type = 'train'), e AS (SELECT coalesce(own, relations) IS NOT NULL AS has_gold FROM pred LEFT JOIN g USING (document_id))
    SELECT count(*) AS num_docs_seen, count(*) FILTER (has_gold) AS num_docs_eval, count(*) FILTER (NOT has_gold) AS num_docs_missing_gold FROM e""",
)
def eval_missing_gold(spark, d):
    docs = documents(spark, d)
    pred = docs.where("pred_relations IS NOT NULL").withColumn("relations", F.when(F.coalesce(F.col("dataset") != "causalbank", F.lit(True)), F.col("relations")))
    return relations.coverage(relations.evaluated_documents(pred.select("document_id", "relations", "pred_relations"), docs.where("type = 'train'")))


@query(
    "merge_predictions",
    f"""{LONG}, s AS (SELECT document_id, rel, head, tail, min((src, pos)) AS "at" FROM (SELECT *, 0 AS src FROM gold UNION ALL SELECT *, 1 FROM pred) GROUP BY document_id, rel, head, tail)
    SELECT document_id, rel, (row_number() OVER (PARTITION BY document_id, rel ORDER BY "at", head, tail) - 1)::INT AS pos, head, tail FROM s""",
)
def merge_predictions(spark, d):
    return relations.merged(*gold_pred(spark, d))


@query("relation_triples", f"{LONG} SELECT * FROM gold")
def relation_triples(spark, d):
    return gold_pred(spark, d)[0]


@query("last_wins", f"WITH {LATEST} SELECT document_id, row_id, strftime(ingested_at, '%Y-%m-%d %H:%M:%S.%f') AS arrived FROM docs")
def last_wins(spark, d):
    return documents(spark, d).selectExpr("document_id", "row_id", "date_format(ingested_at, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS arrived")


@query(
    "filter_skip_limit",
    "SELECT row_id, document_id, type FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS rn FROM re_documents WHERE type IN ('train', 'validation')) WHERE rn BETWEEN 11 AND 60",
)
def filter_skip_limit(spark, d):
    docs = filters.of_type(table(spark, d, "re_documents"), ["train", "validation"]).select("row_id", "document_id", "type")
    return filters.skip_limit(docs, [F.col("row_id")], 10, 50)


_FULL = "coalesce(len(list_filter(map_values(relations), lambda p: len(p) > 0)) > 0, false)"


@query("fewshot_pool_first", f"SELECT row_id FROM (SELECT * FROM re_documents WHERE type = 'train' ORDER BY row_id LIMIT 20 OFFSET 3) WHERE {_FULL} ORDER BY row_id LIMIT 5")
def fewshot_pool_first(spark, d):
    return filters.few_shots(table(spark, d, "re_documents"), 5, [F.col("row_id")], skip=3, pool=20).select("row_id")


@query("fewshot_relations_first", f"SELECT row_id FROM (SELECT * FROM re_documents WHERE type = 'train' AND {_FULL} ORDER BY row_id LIMIT 20 OFFSET 3) ORDER BY row_id LIMIT 5")
def fewshot_relations_first(spark, d):
    return filters.few_shots(table(spark, d, "re_documents"), 5, [F.col("row_id")], skip=3, pool=20, pool_first=False).select("row_id")
