"""Queries that account for runs and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import text as txt
from braidwork.operators import filters, relations, runtime
from braidwork.plans.evaluation import LATEST, LONG, documents, gold_pred
from braidwork.plans.registry import query
from braidwork.sources import sinks
from braidwork.sources.tables import table

_RUNS = "runs AS (SELECT event_id, event_type AS method, user_id::VARCHAR AS dataset, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS status, value AS elapsed_seconds_doc, (event_id % 97 + 1) AS n_eligible_documents FROM events)"


def runs(spark, d):
    """Events as runs: their value as seconds of one document."""
    return table(spark, d, "events").selectExpr("event_id", "event_type AS method", "CAST(user_id AS string) AS dataset", "CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'OK' END AS status", "value AS elapsed_seconds_doc", "event_id % 97 + 1 AS n_eligible_documents")


@query(
    "runtime_energy",
    f"""WITH {_RUNS} SELECT event_id, round(s, 6) AS elapsed_seconds_doc, round(s / 3600 * 0.3, 9) AS energy_kwh_doc, round(s / 3600 * 0.3 * 0.045 * 1000, 8) AS co2_g_doc, round(s * n_eligible_documents / 60, 6) AS estimated_total_minutes,
      round(s / 3600 * 0.3 * 0.045 * n_eligible_documents * 1000, 8) AS estimated_total_co2_g FROM (SELECT *, CASE WHEN status = 'OK' THEN elapsed_seconds_doc END AS s FROM runs)""",
)
def runtime_energy(spark, d):
    e = runtime.energy(runs(spark, d))
    digits = {"elapsed_seconds_doc": 6, "energy_kwh_doc": 9, "co2_g_doc": 8, "estimated_total_minutes": 6, "estimated_total_co2_g": 8}
    return e.select("event_id", *(F.round(c, n).alias(c) for c, n in digits.items()))


@query("runtime_summary", f"WITH {_RUNS} SELECT method, dataset, count(*) AS runs, count(*) FILTER (status = 'OK') AS ok, round(sum(CASE WHEN status = 'OK' THEN elapsed_seconds_doc END), 4) AS seconds FROM runs GROUP BY ALL")
def runtime_summary(spark, d):
    return runs(spark, d).groupBy("method", "dataset").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "OK").alias("ok"), F.round(F.sum(F.when(F.col("status") == "OK", F.col("elapsed_seconds_doc"))), 4).alias("seconds"))


@query("runtime_latex", f"""WITH {_RUNS} SELECT event_id, printf('%s & %s & %d & %.2f & %.2f & %.4f \\\\', method, dataset, n_eligible_documents, 0.5, 2.0, 0.25) AS line FROM runs WHERE status = 'OK'""")
def runtime_latex(spark, d):
    r = runs(spark, d).withColumns({"elapsed_seconds_doc": F.lit(0.5), "estimated_total_minutes": F.lit(2.0), "estimated_total_co2_g": F.lit(0.25)})
    return r.select("event_id", sinks.latex_row().alias("line")).where("line IS NOT NULL")


@query(
    "runtime_override",
    f"""WITH {_RUNS}, o AS (SELECT * FROM runs WHERE event_id % 2 = 0), n AS (SELECT * FROM runs WHERE event_id % 3 = 0)
    SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.method = o.method AND n.dataset = o.dataset)""",
)
def runtime_override(spark, d):
    r = runs(spark, d)
    return relations.overridden(r.where("event_id % 2 = 0"), r.where("event_id % 3 = 0"), ["method", "dataset"])


@query("runtime_named", f"WITH {_RUNS} SELECT * FROM runs WHERE lower(method) IN ('click', 'view') AND lower(dataset) IN ('1', '7', '12')")
def runtime_named(spark, d):
    return filters.named(runs(spark, d), method="Click, VIEW", dataset="1,7,12")


@query("eligible_documents", f"WITH {LATEST} SELECT count(*) AS n_total_documents, count(*) FILTER ((regexp_matches(text, '[^\\s\\x0b\\x85\\p{{Z}}]') OR len(sentences) > 0) AND type IN ('train', 'test')) AS n_eligible_documents FROM docs")
def eligible_documents(spark, d):
    return runtime.eligible(documents(spark, d), ["train", "test"])


@query("document_ids", "SELECT doc_id, 'causalbank - ' || substr(md5(text), 1, 16) AS document_id FROM documents WHERE text IS NOT NULL")
def document_ids(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", txt.document_id("causalbank", "text").alias("document_id"))


@query("graph_export_nodes", f"{LONG} SELECT DISTINCT id FROM (SELECT head AS id FROM gold UNION ALL SELECT tail FROM gold)")
def graph_export_nodes(spark, d):
    return sinks.graph_nodes(gold_pred(spark, d)[0])


@query("document_graphs")
def document_graphs(spark, d):
    gold = gold_pred(spark, d)[0]
    nodes = gold.select("document_id", F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("label", F.col("id"))
    return sinks.document_graphs(nodes, gold)
