"""Readers of JSON lines, graphs in JSON, tables of text, annotation XML and configuration."""

from __future__ import annotations

import csv
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions.text import first_id
from braidwork.operators.filters import last_wins, of_type, skip_limit
from braidwork.sources.schema import CORRUPT, DOCUMENT, ENTITIES


class ConfigurationError(ValueError):
    """A source or a configuration that can't be used as it is."""


def json_lines(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """JSON lines of a fixed schema; lines that aren't JSON keep their text in a column of their own.  Each row knows its file and
    its place there, so later slices have an order."""
    df = spark.read.schema(f"{schema}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})


def documents(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: (id, text, ...) of JSON lines; the query fails at a row without id or text."""
    df = json_lines(spark, path).withColumn("id", first_id("id", "document_id"))
    ok = F.col("id").isNotNull() & (F.col("text").isNotNull())
    return df.where(F.coalesce(F.assert_true(ok, "each row needs an id and a text").cast("string"), F.lit("")) == "")


def gold_relations(spark: SparkSession, path: str) -> DataFrame:
    """SRC2, WIN10: (document_id, relations): lines that can't be read or have no id go; of one id the last line wins; missing relations
    are empty."""
    df = json_lines(spark, path).where(f"{CORRUPT} IS NULL").withColumn("document_id", first_id("document_id", "id"))
    one = last_wins(df.select("document_id", "relations", "_file", "_at"), "document_id", F.desc("_file"), F.desc("_at"))
    return one.select("document_id", F.coalesce("relations", F.create_map().cast("map<string,array<array<string>>>")).alias("relations"))


def slice_of(spark: SparkSession, path: str, types: str | list[str] = "all", skip: int = 0, limit: int | None = None) -> DataFrame:
    """SRC3: documents of the types given, in file order, skip and limit after the filter."""
    df = json_lines(spark, path).where(f"{CORRUPT} IS NULL")
    return skip_limit(of_type(df, types), [F.col("_file"), F.col("_at")], skip, limit)


def field(spark: SparkSession, path: str, name: str) -> DataFrame:
    """SRC4: (document_id, name), the last line of an id winning."""
    df = json_lines(spark, path).where(f"{CORRUPT} IS NULL").withColumn("document_id", first_id("document_id", "id"))
    return last_wins(df.select("document_id", name, "_file", "_at"), "document_id", F.desc("_file"), F.desc("_at")).select("document_id", name)


_EDGE = "struct<head:string,h:string,source:string,rel:string,r:string,type:string,relation:string,tail:string,t:string,target:string,document_id:string,sentence_id:string,sent_id:string,text:string,meta:struct<document_id:string,doc_id:string,sentence_id:string,text:string>>"
_GRAPH = f"document_id string, doc_id string, id string, triples array<string>, kg_triples array<string>, edges array<string>, graph struct<edges:array<string>,nodes:map<string,string>>, nodes map<string,string>"


def _edge(raw: Column, owner: Column) -> Column:
    """An edge from an object with any of the known names, or from a list head, rel, tail and perhaps meta."""
    o = F.from_json(F.when(raw.startswith("{"), raw), _EDGE)
    xs = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    meta = F.from_json(F.get(xs, F.lit(3)), "struct<document_id:string,doc_id:string,sentence_id:string,text:string>")
    pick = lambda *cs: F.coalesce(*(F.nullif(c, F.lit("")) for c in cs))
    return F.struct(
        pick(o["head"], o["h"], o["source"], F.get(xs, F.lit(0))).alias("head"),
        pick(o["rel"], o["r"], o["type"], o["relation"], F.get(xs, F.lit(1)), F.lit("RELATED")).alias("rel"),
        pick(o["tail"], o["t"], o["target"], F.get(xs, F.lit(2))).alias("tail"),
        pick(o["document_id"], o["meta"]["document_id"], o["meta"]["doc_id"], meta["document_id"], meta["doc_id"], owner).alias("document_id"),
        pick(o["sentence_id"], o["sent_id"], o["meta"]["sentence_id"], meta["sentence_id"]).alias("sentence_id"),
        F.coalesce(o["text"], o["meta"]["text"], meta["text"]).alias("text"),
    )


def graph_edges(texts: DataFrame, value: str = "value") -> DataFrame:
    """SRC5, SRC7: (edge_id, head, rel, tail, document_id, sentence_id, text) of a column of JSON texts, each one of: a graph with edges,
    an object with triples, kg_triples or edges, a map from document to triples, a list of such objects or of edges.  Edges may be
    objects with any of the known names, or lists.  The document is the edge's own, that of its meta (B2, B3), or the object's."""
    x = F.col(value)
    listed = F.when(F.trim(x).startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(x))
    each = texts.select(F.monotonically_increasing_id().alias("_t"), F.posexplode(listed).alias("_p", "v"))
    g = F.from_json(F.when(F.col("v").startswith("{"), F.col("v")), _GRAPH)
    own = F.coalesce(g["triples"], g["kg_triples"], g["edges"], g["graph"]["edges"])
    is_edge = F.col("v").startswith("[") | (own.isNull() & F.from_json(F.col("v"), _EDGE)["tail"].isNotNull()) | (own.isNull() & F.coalesce(F.from_json(F.col("v"), _EDGE)["target"], F.from_json(F.col("v"), _EDGE)["t"]).isNotNull())
    by_document = F.transform(F.map_entries(F.map_filter(F.from_json("v", "map<string,string>"), lambda k, v: v.isNotNull() & v.startswith("["))), lambda e: F.struct(e["key"].alias("owner"), F.from_json(e["value"], "array<string>").alias("es")))
    owner = F.coalesce(g["document_id"], g["doc_id"], g["id"])
    groups = F.when(is_edge, F.array(F.struct(F.lit(None).cast("string").alias("owner"), F.array("v").alias("es")))).when(own.isNotNull(), F.array(F.struct(owner.alias("owner"), own.alias("es")))).otherwise(by_document)
    rows = each.select("_t", "_p", F.posexplode(groups).alias("_g", "gr")).select("_t", "_p", "_g", F.col("gr.owner").alias("owner"), F.posexplode("gr.es").alias("_e", "raw"))
    return rows.select(F.struct("_t", "_p", "_g", "_e").alias("edge_id"), _edge(F.col("raw"), F.col("owner")).alias("e")).select("edge_id", "e.*").where("head IS NOT NULL AND tail IS NOT NULL")


def graph_file(spark: SparkSession, path: str) -> DataFrame:
    """SRC5-7: edges of JSON lines if the first line that isn't blank is a JSON value, else of files that are one JSON value (B4)."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    by_line = lines.limit(1).where(F.try_parse_json("value").isNotNull())
    return graph_edges(lines if not by_line.isEmpty() else spark.read.text(path, wholetext=True))


def unknown_documents(edges: DataFrame) -> DataFrame:
    """SRC7: edges without a document get unknown_doc, and without a sentence <document>::edge_<i>, i counting from 0 in edge order."""
    from pyspark.sql import Window

    doc = F.coalesce("document_id", F.lit("unknown_doc"))
    i = F.row_number().over(Window.partitionBy(doc).orderBy("edge_id")) - 1
    return edges.withColumn("sentence_id", F.coalesce("sentence_id", F.concat(doc, F.lit("::edge_"), i))).withColumn("document_id", doc)


def cause_effect(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: (document_id, text, cause, effect) of a tab-separated table with those columns: causalbank_<i> by row, `cause -> effect`, what is
    missing being blank."""
    from pyspark.sql import Window

    df = spark.read.option("sep", "\t").option("header", True).csv(path).withColumns({"_file": F.col("_metadata.file_path"), "_at": F.monotonically_increasing_id()})
    i = F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1
    cause, effect = (F.coalesce(c, F.lit("")) for c in ("cause", "effect"))
    return df.select(F.concat(F.lit("causalbank_"), i.cast("string")).alias("document_id"), F.concat_ws(" -> ", cause, effect).alias("text"), cause.alias("cause"), effect.alias("effect"))


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: a table whose delimiter, ; or , is read off its first 4 KiB; names of columns in any case; empty rows go."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(100).collect())[:4096]
    try:
        sep = csv.Sniffer().sniff(head, ";,").delimiter
    except csv.Error:
        sep = ";" if head.count(";") >= head.count(",") else ","
    df = spark.read.option("sep", sep).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.strip().lower().lstrip("﻿") for c in df.columns)).dropna("all")


def xml_tokens(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (file, t_id, sentence, number, text) of <token> elements."""
    df = spark.read.format("xml").option("rowTag", "token").schema("_t_id int, _sentence int, _number int, _VALUE string").load(path)
    return df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_t_id").alias("t_id"), F.col("_sentence").alias("sentence"), F.col("_number").alias("number"), F.trim("_VALUE").alias("text"))


def span_relations(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: (file, source, target, relation) of lines `source<TAB>target<TAB>relation`, whatever the files are called."""
    parts = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.split(F.trim("value"), "\t").alias("p"))
    return parts.where(F.size("p") >= 3).select("file", *(F.trim(F.col("p")[i]).alias(n) for i, n in enumerate(("source", "target", "relation"))))


def cat_links(spark: SparkSession, path: str, tag: str = "PLOT_LINK") -> DataFrame:
    """SRC14: (file, r_id, relation, source, target) of links of an annotation file: the ids of the markables they join."""
    df = spark.read.format("xml").option("rowTag", tag).schema("_r_id string, _relType string, source struct<_m_id:string>, target struct<_m_id:string>").load(path)
    return df.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_r_id").alias("r_id"), F.col("_relType").alias("relation"), F.col("source._m_id").alias("source"), F.col("target._m_id").alias("target"))


def cat_markables(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """SRC14: (file, m_id, tag, t_ids) of the markables of one tag: the tokens that each covers."""
    df = spark.read.format("xml").option("rowTag", tag).schema("_m_id string, token_anchor array<struct<_t_id:int>>").load(path)
    return df.where("_m_id IS NOT NULL").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("_m_id").alias("m_id"), F.lit(tag).alias("tag"), F.col("token_anchor._t_id").alias("t_ids"))


def newest(paths: list[str]) -> str | None:
    """WIN13: of the files the one of longest, then largest name."""
    return max(paths, key=lambda p: (len(os.path.basename(p)), os.path.basename(p)), default=None)


def config(path: str | None = None, variable: str = "BRAIDWORK_CONFIG", name: str = "config.yaml") -> dict:
    """SRC15: a YAML configuration: the path given, that of the environment variable, or the first found on the way up; its paths are
    made absolute from the file's folder."""
    import yaml

    found = path or os.environ.get(variable) or next((str(p / name) for p in [Path.cwd(), *Path.cwd().parents] if (p / name).exists()), None)
    if not found or not Path(found).exists():
        raise ConfigurationError("no configuration was found")
    data = yaml.safe_load(Path(found).read_text()) or {}
    if not isinstance(data, dict):
        raise ConfigurationError("a configuration must be a map")
    base = Path(found).resolve().parent
    data["paths"] = {k: str((base / v).resolve()) for k, v in (data.get("paths") or {}).items()}
    return data


__all__ = ["ENTITIES", "ConfigurationError", "cat_links", "cat_markables", "cause_effect", "config", "documents", "field", "gold_relations", "graph_edges", "graph_file", "json_lines", "newest", "slice_of", "sniffed_csv", "span_relations", "unknown_documents", "xml_tokens"]
