"""Writers of results, tables, graphs and reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.session import write_text


def json_result(df: DataFrame, path: str) -> None:
    """SNK1: one result as an indented JSON file; more than one row is refused."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("one row is needed")
    write_text(df.sparkSession, path, json.dumps(json.loads(rows[0]), indent=2, ensure_ascii=False))


def json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK2, CNV8."""
    df.write.mode(mode).json(path)


def csv_table(df: DataFrame, path: str, mode: str = "append") -> None:
    """SNK3: a header in each part file; nested columns as JSON."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).csv(path)


def summary(results: DataFrame) -> DataFrame:
    """AGG19: (task_type, n_evidence, output, metric_*): the metrics map as columns, by name."""
    names = sorted(r.k for r in results.select(F.explode(F.map_keys("metrics")).alias("k")).distinct().collect())
    return results.select("task_type", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_evidence"), "output", *(F.try_element_at("metrics", F.lit(n)).alias(f"metric_{n}") for n in names))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """SET4: the ids of the ends of edges, each once."""
    return edges.select(F.explode(F.array("head", "tail")).alias("id")).where("id IS NOT NULL").distinct()


def graph_csv(edges: DataFrame, path: str) -> None:
    """SNK4: edges to `path`, their nodes to `path`_nodes."""
    edges.select(F.col("head").alias("source"), F.col("rel").alias("type"), F.col("tail").alias("target")).write.mode("overwrite").option("header", True).csv(path)
    graph_nodes(edges).write.mode("overwrite").option("header", True).csv(f"{path}_nodes")


def document_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK8: (document_id, graph): each document's nodes (document_id, id, label) and edges (document_id, head, rel, tail) as JSON."""
    n = nodes.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("nodes"))
    e = edges.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("head").alias("source"), F.col("tail").alias("target"), F.col("rel").alias("relation")))).alias("edges"))
    both = n.join(e, "document_id", "full")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return both.select("document_id", F.to_json(F.struct(F.col("document_id").alias("doc_id"), none("nodes", "array<struct<id:string,label:string>>").alias("nodes"), none("edges", "array<struct<source:string,target:string,relation:string>>").alias("edges"))).alias("graph"))


def run_files(results: DataFrame, metrics: DataFrame, manifest: DataFrame, path: str) -> None:
    """SNK5: results as JSON lines, metrics and manifest as JSON files of a folder."""
    results.write.mode("overwrite").json(f"{path}/results")
    json_result(metrics, f"{path}/metrics.json")
    json_result(manifest, f"{path}/manifest.json")


def artefacts(path: str, **frames: DataFrame) -> None:
    """SNK9: each frame as a Parquet table of the folder."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def latex_row() -> Column:
    """SNK7: a row of a LaTeX table for a run that ended well, null for others."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    line = F.format_string("%s & %s & %d & %.2f & %.2f & %.4f \\\\", F.coalesce("method", F.lit("")), F.coalesce("dataset", F.lit("")), F.coalesce("n_eligible_documents", F.lit(0).cast("bigint")), n("elapsed_seconds_doc"), n("estimated_total_minutes"), n("estimated_total_co2_g"))
    return F.when(F.col("status") == "OK", line)
