"""Queries that write a table in some format into the shared folder, read it back with the reader of that format, and give what came through."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidwork.functions import text as txt
from braidwork.operators import convert, ontology, relations
from braidwork.plans.evaluation import LONG, documents
from braidwork.plans.graphs import there, triples
from braidwork.plans.registry import query
from braidwork.session import shared_dir
from braidwork.sources import files, sinks, turtle
from braidwork.sources.tables import table


def folder(spark) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/round-{uuid.uuid4().hex}"


def in_order(df, *by: str):
    """One file in the order given, for readers whose result depends on the order of lines."""
    return df.repartitionByRange(1, *by).sortWithinPartitions(*by)


def lines(spark, df, *by: str) -> str:
    """Where the rows of df now lie as JSON lines."""
    at = folder(spark)
    sinks.json_lines((in_order(df, *by) if by else df), at)
    return at


@query("read_documents", "SELECT doc_id::VARCHAR AS id, md5(text) AS text_hash FROM documents WHERE text IS NOT NULL")
def read_documents(spark, d):
    at = lines(spark, table(spark, d, "documents").where("text IS NOT NULL").selectExpr("string(doc_id) AS document_id", "text"))
    return files.documents(spark, at).select("id", F.md5(F.col("text").cast("binary")).alias("text_hash"))


_LAST = "docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY row_id DESC) AS rn FROM re_documents WHERE document_id <> '') WHERE rn = 1)"


@query("read_gold", f"""WITH {_LAST}, m AS (SELECT document_id, unnest(map_entries(relations)) AS x FROM docs)
  SELECT document_id, x.key AS rel, (i - 1)::INT AS pos, x.value[i][1] AS head, x.value[i][2] AS tail FROM (SELECT *, unnest(range(1, len(x.value) + 1)) AS i FROM m) WHERE len(x.value[i]) = 2 AND x.value[i][1] IS NOT NULL AND x.value[i][2] IS NOT NULL""")
def read_gold(spark, d):
    """Gold relations of JSON lines, the last line of an id winning, beside lines that can't be read."""
    at = lines(spark, table(spark, d, "re_documents").select("row_id", "document_id", "relations"), "row_id")
    spark.range(1).selectExpr("'{cut off' AS value").write.mode("append").text(at)
    return relations.triples(files.gold_relations(spark, at))


@query("read_field", f"WITH {_LAST} SELECT document_id, title FROM docs")
def read_field(spark, d):
    return files.field(spark, lines(spark, table(spark, d, "re_documents").select("row_id", "document_id", "title"), "row_id"), "title")


@query("read_slice", "SELECT document_id, title FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM re_documents WHERE type = 'train') WHERE n BETWEEN 6 AND 45")
def read_slice(spark, d):
    at = lines(spark, table(spark, d, "re_documents").select("row_id", "document_id", "title", "type"), "row_id")
    return files.slice_of(spark, at, "train", 5, 40).select("document_id", "title")


_WHOLE = "head <> '' AND tail <> ''"
_REL = "coalesce(nullif(rel, ''), 'RELATED') AS rel"


@query("read_graph_lines", f"SELECT head, {_REL}, tail, nullif(document_id, '') AS document_id FROM kg_triples WHERE {_WHOLE}")
def read_graph_lines(spark, d):
    """Edges as lines of three shapes: objects of two vocabularies, and lists with a map behind."""
    e = triples(spark, d).where(_WHOLE)
    one = F.to_json(F.struct("head", "rel", "tail", "document_id"))
    two = F.to_json(F.struct(F.col("head").alias("source"), F.col("rel").alias("relation"), F.col("tail").alias("target"), F.struct(F.col("document_id").alias("doc_id")).alias("meta")))
    item = lambda c: F.regexp_extract(F.to_json(F.array(F.coalesce(c, F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    three = F.concat(F.lit('{"edges":[['), F.concat_ws(",", *(item(F.col(c)) for c in ("head", "rel", "tail")), F.to_json(F.struct("document_id"))), F.lit("]]}"))
    at = folder(spark)
    e.select(F.when(F.col("edge_id") % 3 == 0, one).when(F.col("edge_id") % 3 == 1, two).otherwise(three)).write.text(at)
    return files.graph_file(spark, at).select("head", "rel", "tail", "document_id")


@query("read_graph_documents", f"SELECT document_id, head, {_REL}, tail FROM kg_triples WHERE {_WHOLE} AND document_id <> ''")
def read_graph_documents(spark, d):
    """One object per document with its triples; a document that holds much of the table is cut into several lines."""
    e = triples(spark, d).where(f"{_WHOLE} AND document_id <> ''").groupBy("document_id", F.floor(F.col("edge_id") / 1000)).agg(F.collect_list(F.array("head", F.coalesce("rel", F.lit("")), "tail")).alias("triples"))
    return files.graph_file(spark, lines(spark, e.select("document_id", "triples"))).select("document_id", "head", "rel", "tail")


@query("read_graph_maps", f"SELECT document_id, head, {_REL}, tail FROM kg_triples WHERE {_WHOLE} AND document_id <> '' AND document_id <> 'graph'")
def read_graph_maps(spark, d):
    """Maps from document to triples, each a file of its own that is one JSON value over several lines."""
    e = triples(spark, d).where(f"{_WHOLE} AND document_id <> '' AND document_id <> 'graph'").groupBy("document_id").agg(F.collect_list(F.array("head", F.coalesce("rel", F.lit("")), "tail")).alias("t"))
    by = e.groupBy(F.pmod(F.xxhash64("document_id"), F.lit(8)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("document_id", "t"))).alias("m"))
    at = folder(spark)
    by.repartition(8, "part").select(F.regexp_replace(F.to_json("m"), r"^\{", "{\n")).write.option("maxRecordsPerFile", 1).text(at)
    return files.graph_file(spark, at).select("document_id", "head", "rel", "tail")


@query("unknown_documents", f"""SELECT coalesce(nullif(document_id, ''), 'unknown_doc') AS document_id, coalesce(nullif(sentence_id, ''), coalesce(nullif(document_id, ''), 'unknown_doc') || '::edge_' || (row_number() OVER (PARTITION BY coalesce(nullif(document_id, ''), 'unknown_doc') ORDER BY triple_id) - 1)) AS sentence_id, head, tail
  FROM kg_triples WHERE {_WHOLE}""")
def unknown_documents(spark, d):
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    return files.unknown_documents(triples(spark, d).where(_WHOLE).select("edge_id", "head", "tail", blank("document_id"), blank("sentence_id"))).select("document_id", "sentence_id", "head", "tail")


_CLEAN = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[^A-Za-z0-9 .]+', ' ', 'g'))"


def _clean(c: str):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9 .]+", " "))


@query("read_cause_effect", f"SELECT 'causalbank_' || (row_number() OVER (ORDER BY pred_id) - 1) AS document_id, c || ' -> ' || e AS text, c AS cause, e AS effect FROM (SELECT pred_id, {_CLEAN('pred_source_span')} AS c, {_CLEAN('pred_target_span')} AS e FROM esl_predictions)")
def read_cause_effect(spark, d):
    at = folder(spark)
    rows = table(spark, d, "esl_predictions").select("pred_id", _clean("pred_source_span").alias("cause"), _clean("pred_target_span").alias("effect"))
    in_order(rows, "pred_id").select("cause", "effect").write.option("sep", "\t").option("header", True).csv(at)
    return files.cause_effect(spark, at)


@query("read_csv", f"SELECT pred_id::VARCHAR AS id, nullif({_CLEAN('pred_source_span')}, '') AS span, nullif({_CLEAN('model')}, '') AS model FROM esl_predictions")
def read_csv(spark, d):
    """A table whose delimiter is found out, with names in capitals."""
    at = folder(spark)
    table(spark, d, "esl_predictions").select(F.col("pred_id").alias("ID"), _clean("pred_source_span").alias("Span"), _clean("model").alias("MODEL")).write.option("sep", ";").option("header", True).csv(at)
    return files.sniffed_csv(spark, at).select("id", "span", "model")


_WORD = r"list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]+'), lambda w: w <> '')"
_TOKENS = f"tok AS (SELECT (item_id * 1000 + i)::INT AS t_id, item_id::INT AS sentence, i::INT AS number, ws[i] AS text FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT item_id, {_WORD} AS ws FROM eval_passages)))"


def tokens(spark, d):
    """The words of the evaluation passages as tokens of one annotated file, a passage being a sentence."""
    ws = table(spark, d, "eval_passages").select("item_id", F.posexplode(F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda w: w != "")).alias("i", "text"))
    return ws.select((F.col("item_id") * 1000 + F.col("i") + 1).cast("int").alias("t_id"), F.col("item_id").cast("int").alias("sentence"), (F.col("i") + 1).alias("number"), "text")


def annotated(spark, body) -> str:
    """A file of XML lines (line) within one element."""
    at = folder(spark)
    inner = body.select("line", F.lit(1).alias("o"))
    both = inner.unionAll(spark.createDataFrame([("<Document>", 0), ("</Document>", 2)], "line string, o int"))
    both.repartitionByRange(1, "o").sortWithinPartitions("o").select("line").write.text(at)
    return at


@query("read_tokens", f"WITH {_TOKENS} SELECT * FROM tok")
def read_tokens(spark, d):
    t = tokens(spark, d).select(F.format_string('<token t_id="%d" sentence="%d" number="%d">%s</token>', "t_id", "sentence", "number", "text").alias("line"))
    return files.xml_tokens(spark, annotated(spark, t)).drop("file")


@query("read_markables", f"WITH {_TOKENS} SELECT 'm' || sentence AS m_id, 'ACTION_OCCURRENCE' AS tag, array_to_string(list(t_id ORDER BY t_id), ' ') AS t_ids FROM tok WHERE number <= 3 GROUP BY sentence")
def read_markables(spark, d):
    anchors = tokens(spark, d).where("number <= 3").groupBy("sentence").agg(F.array_join(F.array_sort(F.collect_list(F.format_string('<token_anchor t_id="%d"/>', "t_id"))), "").alias("a"))
    m = anchors.select(F.format_string('<ACTION_OCCURRENCE m_id="m%d">%s</ACTION_OCCURRENCE>', "sentence", "a").alias("line"))
    return files.cat_markables(spark, annotated(spark, m), "ACTION_OCCURRENCE").select("m_id", "tag", F.array_join(F.array_sort("t_ids"), " ").alias("t_ids"))


@query("read_links", "SELECT triple_id::VARCHAR AS r_id, 'PRECONDITION' AS relation, 'm' || (triple_id % 97) AS source, 'm' || (triple_id % 89) AS target FROM kg_triples")
def read_links(spark, d):
    one = triples(spark, d).select(F.format_string('<PLOT_LINK r_id="%d" relType="PRECONDITION"><source m_id="m%d"/><target m_id="m%d"/></PLOT_LINK>', "edge_id", F.col("edge_id") % 97, F.col("edge_id") % 89).alias("line"))
    return files.cat_links(spark, annotated(spark, one)).drop("file")


@query("read_span_relations", f"SELECT trim(head) AS source, trim(tail) AS target, trim(rel) AS relation FROM (SELECT {_CLEAN('head')} AS head, {_CLEAN('rel')} AS rel, {_CLEAN('tail')} AS tail FROM kg_triples) WHERE head <> '' AND rel <> '' AND tail <> ''")
def read_span_relations(spark, d):
    at = folder(spark)
    triples(spark, d).select(*(_clean(c).alias(c) for c in ("head", "tail", "rel"))).where("head <> '' AND rel <> '' AND tail <> ''").select(F.concat_ws("\t", "head", "tail", "rel")).write.text(at)
    return files.span_relations(spark, at).drop("file")


@query("read_turtle", "SELECT uri, label, description, array_to_string(list_sort(coalesce(aliases, [])), '|') AS aliases FROM ontology_concepts WHERE label IS NOT NULL")
def read_turtle(spark, d):
    """Concepts as classes in a Turtle file, and read from it again."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    said = F.concat_ws(" ;\n  ", F.lit("a owl:Class"), F.concat(F.lit("rdfs:label "), quoted(F.col("label"))), F.concat(F.lit("rdfs:comment "), quoted(F.col("description"))), F.concat(F.lit("skos:altLabel "), F.array_join(F.transform(F.nullif("aliases", F.array().cast("array<string>")), quoted), ", ")))
    at = folder(spark)
    table(spark, d, "ontology_concepts").where("label IS NOT NULL").select(F.concat(F.lit("<"), "uri", F.lit("> "), said, F.lit(" ."))).write.text(at)
    return turtle.concepts(turtle.cached(spark, at)).select("uri", "label", "description", F.array_join("aliases", "|").alias("aliases"))


@query("fragment_turtle", "SELECT uri AS s, 'http://www.w3.org/2000/01/rdf-schema#label' AS p, label AS o, false AS o_is_iri FROM ontology_concepts WHERE label IS NOT NULL UNION ALL SELECT uri, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://www.w3.org/2002/07/owl#Class', true FROM ontology_concepts")
def fragment_turtle(spark, d):
    """A fragment written as Turtle and parsed again."""
    c = table(spark, d, "ontology_concepts")
    wanted = c.select(F.lit("d").alias("document_id"), F.lit("class").alias("kind"), "uri")
    none = spark.createDataFrame([], "document_id string, uri string, label string, domains array<string>, ranges array<string>")
    ttl = ontology.turtle(ontology.fragment(none, wanted, c.select("uri", "label")))
    return turtle.triples(ttl, "ttl", "document_id").drop("document_id")


@query("write_csv", "SELECT document_id, title FROM re_documents WHERE title <> '' AND document_id <> ''")
def write_csv(spark, d):
    """A table with a nested column written as CSV with headers, and read again."""
    at = folder(spark)
    sinks.csv_table(table(spark, d, "re_documents").where("title <> '' AND document_id <> ''").select("document_id", "title", "relations"), at)
    return spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(at).select("document_id", "title")


@query("write_graph", "SELECT head AS source, rel AS type, tail AS target, NULL::VARCHAR AS id FROM (SELECT %s AS head, %s AS rel, %s AS tail FROM kg_triples) WHERE head <> '' AND rel <> '' AND tail <> '' UNION ALL SELECT NULL, NULL, NULL, id FROM (SELECT %s AS id FROM kg_triples WHERE %s <> '' AND %s <> '' UNION SELECT %s FROM kg_triples WHERE %s <> '' AND %s <> '') WHERE id <> ''" % (_CLEAN("head"), _CLEAN("rel"), _CLEAN("tail"), _CLEAN("head"), _CLEAN("rel"), _CLEAN("tail"), _CLEAN("tail"), _CLEAN("rel"), _CLEAN("head")))
def write_graph(spark, d):
    """Edges and their nodes as two CSV tables."""
    at = folder(spark)
    sinks.graph_csv(triples(spark, d).select(*(_clean(c).alias(c) for c in ("head", "rel", "tail"))).where("head <> '' AND rel <> '' AND tail <> ''"), at)
    edges, nodes = (spark.read.option("header", True).csv(p) for p in (at, f"{at}_nodes"))
    return edges.withColumn("id", F.lit(None).cast("string")).unionByName(nodes, allowMissingColumns=True)


@query("write_run", "SELECT item_id AS task_id, 'results' AS part FROM eval_passages UNION ALL SELECT count(*), 'metrics' FROM eval_passages UNION ALL SELECT 7, 'manifest'")
def write_run(spark, d):
    """The files of a run: results, metrics, manifest."""
    at = folder(spark)
    tasks = table(spark, d, "eval_passages").select(F.col("item_id").alias("task_id"))
    sinks.run_files(tasks, tasks.agg(F.count("*").alias("n")), spark.range(1).select(F.lit(7).alias("seed")), at)
    one = lambda name, c: spark.read.option("multiLine", True).json(f"{at}/{name}.json").select(F.col(c).cast("bigint").alias("task_id"), F.lit(name).alias("part"))
    return spark.read.schema("task_id bigint").json(f"{at}/results").withColumn("part", F.lit("results")).unionAll(one("metrics", "n")).unionAll(one("manifest", "seed"))


@query("write_artefacts", f"SELECT head AS a, tail AS b, 'edges' AS part FROM kg_triples WHERE {there('head')} AND {there('tail')} UNION ALL SELECT uri, label, 'nodes' FROM ontology_concepts")
def write_artefacts(spark, d):
    at = folder(spark)
    e = triples(spark, d).where(F.col("head").rlike(r"(?U)\S") & F.col("tail").rlike(r"(?U)\S"))
    sinks.artefacts(at, edges=e.selectExpr("head AS a", "tail AS b"), nodes=table(spark, d, "ontology_concepts").selectExpr("uri AS a", "label AS b"))
    return spark.read.parquet(f"{at}/edges").withColumn("part", F.lit("edges")).unionAll(spark.read.parquet(f"{at}/nodes").withColumn("part", F.lit("nodes")))


@query("document_graph_edges", f"{LONG} SELECT document_id, head, rel, tail FROM gold WHERE head <> '' AND tail <> '' AND rel <> ''")
def document_graph_edges(spark, d):
    """Per-document graphs as JSON, and their edges read again."""
    long = relations.triples(documents(spark, d)).where("head <> '' AND tail <> '' AND rel <> ''")
    nodes = long.select("document_id", F.explode(F.array("head", "tail")).alias("id")).distinct().withColumn("label", F.col("id"))
    return files.graph_edges(sinks.document_graphs(nodes, long), "graph").select("document_id", "head", "rel", "tail")


@query("summary_table", "SELECT task_type, n_evidence::INT AS n_evidence, output, v AS metric_v, w AS metric_w FROM (SELECT 'claim' AS task_type, item_id % 4 AS n_evidence, benchmark AS output, (item_id % 10)::DOUBLE AS v, CASE WHEN item_id % 2 = 0 THEN item_id::DOUBLE END AS w FROM eval_passages)")
def summary_table(spark, d):
    r = table(spark, d, "eval_passages").select(F.lit("claim").alias("task_type"), F.sequence(F.lit(1), F.lit(4)).alias("s"), "item_id", F.col("benchmark").alias("output"))
    evidence = F.slice("s", F.lit(1), (F.col("item_id") % 4).cast("int"))
    metrics = F.map_filter(F.create_map(F.lit("v"), (F.col("item_id") % 10).cast("double"), F.lit("w"), F.when(F.col("item_id") % 2 == 0, F.col("item_id").cast("double"))), lambda k, v: v.isNotNull())
    return sinks.summary(r.select("task_type", evidence.alias("evidence"), "output", metrics.alias("metrics")))


@query("config_values", "SELECT * FROM (VALUES ('model', 'echo'), ('top_k', '5'), ('paths.data', 'in')) t(name, value)")
def config_values(spark, d):
    """A configuration whose relative paths are taken from its own folder."""
    import tempfile
    from pathlib import Path

    with tempfile.TemporaryDirectory() as at:  # a configuration is a file of the driver
        (Path(at) / "config.yaml").write_text("model: echo\ntop_k: 5\npaths:\n  data: in\n")
        got = files.config(f"{at}/config.yaml")
    return spark.createDataFrame([("model", got["model"]), ("top_k", str(got["top_k"])), ("paths.data", str(Path(got["paths"]["data"]).relative_to(Path(at).resolve())))], "name string, value string")


# converters over stand-ins


_LINES = f"l AS (SELECT pred_id, {_CLEAN('pred_source_span')} AS p1, {_CLEAN('pred_target_span')} AS p2 FROM esl_predictions)"
_STEMMED = lambda w: f"(SELECT CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN t[:-4] WHEN t LIKE '%ed' AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%ly' AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%es' AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%s' AND length(t) > 3 THEN t[:-2] ELSE t END FROM (SELECT regexp_replace(lower({w}), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS t))"
_SPLIT = lambda c: f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
_PAIRS = f"pairs AS (SELECT DISTINCT a AS cause, b AS effect FROM (SELECT {_STEMMED('p1[1:coalesce(nullif(instr(p1, chr(32)), 0), 9999) - 1]')} AS a, {_STEMMED('p2[1:coalesce(nullif(instr(p2, chr(32)), 0), 9999) - 1]')} AS b FROM l WHERE p1 <> '' AND p2 <> '') WHERE a <> '' AND b <> '')"


def _bank(spark, d):
    rows = table(spark, d, "esl_predictions").select(F.lit("f").alias("file"), F.col("pred_id").alias("line"), F.lit("leads to").alias("connector"), _clean("pred_source_span").alias("p1"), _clean("pred_target_span").alias("p2"))
    word = lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    lex = rows.where("p1 <> '' AND p2 <> ''").select(F.concat(word(F.col("p1")), F.lit("->"), word(F.col("p2")), F.lit("\t3\t"), "p1").alias("value"))
    return rows, convert.lexicon(lex)


@query("causal_lexicon", f"WITH {_LINES}, {_PAIRS} SELECT * FROM pairs")
def causal_lexicon(spark, d):
    """First words of the typed spans as a lexicon of causes and effects."""
    return _bank(spark, d)[1]


@query(
    "convert_causalbank",
    f"""WITH {_LINES}, {_PAIRS}, ok AS (SELECT *, p1 || ' leads to ' || p2 AS text FROM l WHERE p1 <> '' AND p2 <> ''),
    ws AS (SELECT DISTINCT pred_id, text, {_STEMMED('w')} AS stem FROM (SELECT pred_id, text, unnest({_SPLIT('text')}) AS w FROM ok))
    SELECT text, a.stem AS cause, b.stem AS effect, count(*) AS n FROM ws a JOIN ws b USING (pred_id, text) JOIN pairs ON cause = a.stem AND effect = b.stem WHERE a.stem <> b.stem GROUP BY ALL""",
)
def convert_causalbank(spark, d):
    """Typed spans as causal sentences: the pairs of stems in each that the lexicon holds."""
    rows, pairs = _bank(spark, d)
    docs = convert.convert("causalbank", rows, pairs)
    lemma = lambda c: F.try_element_at("entities", F.col(c))["lemma"]
    each = docs.select("text", "entities", F.explode("relations.causal_relation").alias("p")).select("text", "entities", F.col("p")[0].alias("h"), F.col("p")[1].alias("t"))
    return each.select("text", lemma("h").alias("cause"), lemma("t").alias("effect")).groupBy("text", "cause", "effect").agg(F.count("*").alias("n"))


@query(
    "convert_fincausal",
    f"""WITH {_LINES} SELECT DISTINCT 'fincausal - ' || md5(text)[1:16] AS document_id, text, nullif(p1, '') AS cause, nullif(p2, '') AS effect, (p1 <> '' AND p2 <> '')::INT AS pairs FROM (SELECT p1, p2, trim('So ' || p1 || ' and then ' || p2 || '.') AS text FROM l)""",
)
def convert_fincausal(spark, d):
    """Typed spans put into tagged sentences: cause and effect found by their tags."""
    rows = table(spark, d, "esl_predictions").select(_clean("pred_source_span").alias("p1"), _clean("pred_target_span").alias("p2"))
    docs = convert.convert("fincausal", rows.select(F.concat(F.lit("So <e1>"), "p1", F.lit("</e1> and then <e2>"), "p2", F.lit("</e2>.")).alias("Text")))
    said = lambda kind: F.get(F.filter(F.map_values("entities"), lambda e: e["type"] == kind), F.lit(0))["mentions"][0]["trigger_word"]
    return docs.select("document_id", "text", said("CAUSE").alias("cause"), said("EFFECT").alias("effect"), F.size("relations.CAUSE").alias("pairs")).distinct()


@query(
    "convert_event_spans",
    f"""WITH {_TOKENS}, n AS (SELECT sentence, max(number) AS k FROM tok GROUP BY sentence), s AS (SELECT sentence, k FROM n WHERE k >= 4),
    t AS (SELECT sentence, array_to_string(list(text ORDER BY number), ' ') AS said FROM tok GROUP BY sentence), w AS (SELECT sentence, number, text FROM tok)
    SELECT 'f' || sentence AS title, (SELECT text FROM w WHERE w.sentence = s.sentence AND number = 1) || ' ' || (SELECT text FROM w WHERE w.sentence = s.sentence AND number = 2) AS head,
      (SELECT text FROM w WHERE w.sentence = s.sentence AND number = 4) AS tail, 'PRECONDITION' AS rel, 'eventstoryline - ' || md5(said)[1:16] AS document_id FROM s JOIN t USING (sentence)""",
)
def convert_event_spans(spark, d):
    """Passages as annotated files: a link from each one's first two tokens to its fourth, and one to a token that isn't there."""
    t = tokens(spark, d).withColumn("file", F.concat(F.lit("f"), "sentence"))
    at = F.col("sentence") * 1000
    links = t.select("file", "sentence").distinct().select("file", F.concat_ws("_", (at + 1).cast("string"), (at + 2).cast("string")).alias("source"), F.explode(F.array((at + 4).cast("string"), F.lit("999999999"))).alias("target"), F.lit("PRECONDITION").alias("relation"))
    docs = convert.convert("eventstoryline", t, links)
    word = lambda c: F.try_element_at("entities", F.col(c))["mentions"][0]["trigger_word"]
    long = docs.select("title", "document_id", "entities", F.explode("relations").alias("rel", "ps")).select("title", "document_id", "entities", "rel", F.explode("ps").alias("p")).select("title", "document_id", "entities", "rel", F.col("p")[0].alias("h"), F.col("p")[1].alias("t"))
    return long.select("title", word("h").alias("head"), word("t").alias("tail"), "rel", "document_id")


@query(
    "convert_docred",
    f"""WITH p AS (SELECT item_id, {_WORD} AS ws FROM eval_passages WHERE len({_WORD}) >= 4)
    SELECT 'DocRED - ' || md5(array_to_string(ws, ' '))[1:16] AS document_id, rel, ws[1] || ' ' || ws[2] AS head, ws[4] AS tail FROM p, (VALUES ('P17 : country'), ('P9')) r(rel)""",
)
def convert_docred(spark, d):
    """Passages as sentences with two clusters of mentions and labels, one of which has a name and one points nowhere."""
    ws = table(spark, d, "eval_passages").select("item_id", F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda w: w != "").alias("ws")).where("size(ws) >= 4")
    m = lambda a, b: F.array(F.struct(F.lit("n").alias("name"), F.array(F.lit(a), F.lit(b)).alias("pos"), F.lit(0).alias("sent_id"), F.lit("LOC").alias("type")))
    label = lambda h, t, r: F.struct(F.lit(h).alias("h"), F.lit(t).alias("t"), F.lit(r).alias("r"), F.array(F.lit(0)).alias("evidence"))
    raw = ws.select(F.concat(F.lit("s"), "item_id").alias("split"), F.col("item_id").cast("string").alias("title"), F.array("ws").alias("sents"), F.array(m(0, 2), m(3, 4)).alias("vertexSet"), F.array(label(0, 1, "P17"), label(0, 1, "P9"), label(0, 7, "P17")).alias("labels"))
    docs = convert.docred(raw, spark.createDataFrame([("P17", "country")], "r string, name string"))
    word = lambda c: F.try_element_at("entities", F.col(c))["mentions"][0]["trigger_word"]
    long = docs.select("document_id", "entities", F.explode("relations").alias("rel", "ps")).select("document_id", "entities", "rel", F.explode("ps").alias("p")).select("document_id", "entities", "rel", F.col("p")[0].alias("h"), F.col("p")[1].alias("t"))
    return long.select("document_id", "rel", word("h").alias("head"), word("t").alias("tail"))


_CHAINS = "x AS (SELECT triple_id, triple_id % 50 AS a, (triple_id * 7) % 50 AS b, CASE triple_id % 3 WHEN 0 THEN 'PRECONDITION' WHEN 1 THEN 'FALLING_ACTION' ELSE 'OTHER' END AS rel FROM kg_triples)"


@query(
    "merged_gold",
    f"""WITH {_CHAINS}, links AS (SELECT DISTINCT 'f' || (triple_id % 11) AS file, a::VARCHAR AS source, b::VARCHAR AS target, rel FROM x WHERE triple_id % 2 = 0), chains AS (SELECT DISTINCT 'f' || (triple_id % 11) AS file, a::VARCHAR AS span, m::VARCHAR AS member FROM x, (VALUES (0), (1)) v(k), LATERAL (SELECT a + k * 50 AS m) WHERE a < 10),
    wide AS (SELECT l.file, coalesce(s.member, l.source) AS a, coalesce(t.member, l.target) AS b, rel, l.source, l.target FROM links l LEFT JOIN chains s ON s.file = l.file AND s.span = l.source LEFT JOIN chains t ON t.file = l.file AND t.span = l.target),
    turned AS (SELECT file, CASE WHEN a::INT < b::INT THEN a ELSE b END AS source, CASE WHEN a::INT < b::INT THEN b ELSE a END AS target, CASE WHEN a::INT < b::INT THEN rel WHEN rel = 'PRECONDITION' THEN 'FALLING_ACTION' WHEN rel = 'FALLING_ACTION' THEN 'PRECONDITION' ELSE rel END AS relation, (source, target) AS o FROM wide WHERE a::INT <> b::INT)
    SELECT file, source, target, arg_max(relation, (o, relation)) AS relation FROM turned GROUP BY file, source, target""",
)
def merged_gold(spark, d):
    """Links between numbered spans, spread over coreference chains and turned to textual order."""
    x = triples(spark, d).select("edge_id", (F.col("edge_id") % 50).alias("a"), ((F.col("edge_id") * 7) % 50).alias("b"), F.concat(F.lit("f"), F.col("edge_id") % 11).alias("file"), F.when(F.col("edge_id") % 3 == 0, "PRECONDITION").when(F.col("edge_id") % 3 == 1, "FALLING_ACTION").otherwise("OTHER").alias("relation"))
    links = x.where("edge_id % 2 = 0").select("file", F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), "relation").distinct()
    chains = x.where("a < 10").select("file", F.col("a").cast("string").alias("span"), F.explode(F.array(F.col("a").cast("string"), (F.col("a") + 50).cast("string"))).alias("member")).distinct()
    return convert.merged_gold(links, chains)


@query("gold_union", "SELECT document_id AS doc_id, head AS source, tail AS target, rel AS relation FROM kg_triples WHERE triple_id % 2 = 0 UNION SELECT document_id, head, tail, rel FROM kg_triples WHERE triple_id % 3 = 0")
def gold_union(spark, d):
    e = triples(spark, d).select("edge_id", F.col("document_id").alias("doc_id"), F.col("head").alias("source"), F.col("tail").alias("target"), F.col("rel").alias("relation"))
    return convert.gold_union(e.where("edge_id % 2 = 0"), e.where("edge_id % 3 = 0"))


@query("gold_concatenated", "SELECT document_id AS doc_id, head AS source, tail AS target, rel AS relation FROM kg_triples WHERE triple_id % 2 = 0 UNION ALL SELECT document_id, head, tail, rel FROM kg_triples WHERE triple_id % 3 = 0")
def gold_concatenated(spark, d):
    e = triples(spark, d).select("edge_id", F.col("document_id").alias("doc_id"), F.col("head").alias("source"), F.col("tail").alias("target"), F.col("rel").alias("relation"))
    return convert.gold_union(e.where("edge_id % 2 = 0"), e.where("edge_id % 3 = 0"), distinct=False)


@query(
    "aligned_events",
    """WITH w AS (SELECT pred_id, 'd' || (pred_id % 20) AS doc_id, [pred_id % 13, pred_id % 7, pred_id % 5] AS ts FROM esl_predictions), ev AS (SELECT 'd' || k AS doc_id, 'e' || j AS event_id, j AS pos, [j, j + 1, (j * 3) % 13] AS ts FROM range(20) a(k), range(12) b(j)),
    hits AS (SELECT w.doc_id, pred_id AS line, event_id, pos, len(list_intersect(list_distinct(w.ts), list_distinct(ev.ts))) AS n FROM w JOIN ev USING (doc_id))
    SELECT doc_id, line, 's' AS side, (SELECT event_id FROM hits h WHERE h.line = w.pred_id AND h.doc_id = w.doc_id AND n > 0 ORDER BY n DESC, pos LIMIT 1) AS event_id FROM (SELECT doc_id, pred_id, pred_id AS line FROM w) w""",
)
def aligned_events(spark, d):
    """Token ids made from numbers: lines against events by most shared tokens."""
    p = F.col("pred_id")
    lines_ = table(spark, d, "esl_predictions").select(F.concat(F.lit("d"), p % 20).alias("doc_id"), p.alias("line"), F.lit("s").alias("side"), F.array(p % 13, p % 7, p % 5).alias("t_ids"))
    j = F.col("id") % 12
    events = spark.range(240).select(F.concat(F.lit("d"), F.floor(F.col("id") / 12)).alias("doc_id"), F.concat(F.lit("e"), j).alias("event_id"), j.alias("pos"), F.array(j, j + 1, (j * 3) % 13).alias("t_ids"))
    return convert.aligned(lines_, events)


@query("augmented_schema", f"""WITH {LONG.removeprefix('WITH ')}, own AS (SELECT document_id, CASE WHEN trim(split_part(k, ':', 1)) = 'P17' THEN 'P17 : country' WHEN trim(split_part(k, ':', 1)) = 'P828' THEN 'P828 : has cause' ELSE k END AS t FROM (SELECT document_id, unnest(map_keys(relations)) AS k FROM docs)),
  every AS (SELECT document_id, t FROM own UNION SELECT document_id, t FROM docs, (VALUES ('P17 : country'), ('P828 : has cause')) v(t)) SELECT document_id, string_agg(t, '|' ORDER BY t) AS types FROM every GROUP BY document_id""")
def augmented_schema(spark, d):
    rel = spark.createDataFrame([("P17", "country"), ("P828", "has cause")], "r string, name string")
    return convert.schema_of(documents(spark, d), rel).select("document_id", F.array_join("types", "|").alias("types"))


@query("convert_ids", "SELECT doc_id, 'documents - ' || md5(text)[1:16] AS document_id, CASE WHEN contains(lower(p), 'train') THEN 'train' WHEN contains(lower(p), 'dev') OR contains(lower(p), 'val') THEN 'validation' WHEN contains(lower(p), 'test') THEN 'test' ELSE 'unknown' END AS split FROM (SELECT doc_id, text, coalesce(split, 'x') || '.jsonl' AS p FROM documents WHERE text IS NOT NULL)")
def convert_ids(spark, d):
    """Ids by hash and splits by file name."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", txt.document_id("documents", "text").alias("document_id"), convert.split_of(F.concat(F.lit("in/"), F.coalesce("split", F.lit("x")), F.lit(".jsonl"))).alias("split"))
