"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import canon, crosssplit, facts, leak, level, mix, nearsame, split
from braidwork.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query (spark, directory) -> DataFrame and, if it can be written, its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _pieces(spark, d):
    items = split.sentence_items(table(spark, d, "re_documents")).unionAll(split.chunk_items(table(spark, d, "chunk_orag_chunks")))
    return split.split(items, table(spark, d, "split_limits"))


_OVERSIZED = """
    SELECT item_kind, item_id, item_pos, text, max_chars, overlap_chars FROM (
      SELECT 'sentence' AS item_kind, row_id AS item_id, (i - 1)::INT AS item_pos, sentences[i] AS text
      FROM (SELECT row_id, sentences, unnest(range(1, len(sentences) + 1)) AS i FROM re_documents)
      UNION ALL SELECT 'chunk', chunk_id, 0::INT, text FROM chunk_orag_chunks)
    JOIN split_limits USING (item_kind) WHERE length(text) > max_chars"""


@query("p2_found", f"SELECT item_kind, item_id, item_pos FROM ({_OVERSIZED})")
def p2_found(spark, d):
    return _pieces(spark, d).where("piece = 0").select("item_kind", "item_id", "item_pos")


@query("p2_pieces")
def p2_pieces(spark, d):
    return _pieces(spark, d)


@query("p2_whole", f"SELECT item_kind, item_id, item_pos, md5(text) AS text_hash, true AS holds FROM ({_OVERSIZED})")
def p2_whole(spark, d):
    """Each split item put together from its pieces, and whether all of them keep to limit and overlap."""
    limits = table(spark, d, "split_limits")
    ps = _pieces(spark, d).join(F.broadcast(limits), "item_kind").groupBy("item_kind", "item_id", "item_pos", "max_chars", "overlap_chars")
    ps = ps.agg(F.array_sort(F.collect_list(F.struct("piece", "start_char", "end_char", "piece_text"))).alias("ps"))  # the pieces of one text
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("t"), F.lit(True).alias("ok"))
    joined = F.aggregate(
        "ps",
        start,
        lambda a, x: F.struct(
            x["end_char"].alias("at"),
            F.concat(a["t"], F.substr(x["piece_text"], a["at"] - x["start_char"] + 1)).alias("t"),
            (a["ok"] & (x["start_char"] == F.greatest(F.lit(0), a["at"] - F.col("overlap_chars"))) & (F.length(x["piece_text"]) <= F.col("max_chars"))).alias("ok"),
        ),
    )
    return ps.withColumn("j", joined).select("item_kind", "item_id", "item_pos", F.md5(F.col("j.t").cast("binary")).alias("text_hash"), F.col("j.ok").alias("holds"))


def _records(spark, d):
    return table(spark, d, "kg_triples").selectExpr("triple_id AS id", "head", "rel", "tail").unionAll(facts.line_facts(table(spark, d, "triple_lines")))


_VALUE = lambda names: f"coalesce(CASE WHEN l LIKE '{{%' THEN CASE WHEN json_valid(l) THEN coalesce({', '.join(f'''json_extract_string(l, '$.{n}')''' for n in names)}) END END, CASE WHEN NOT l LIKE '{{%' THEN json_extract_string('[' || nullif(regexp_extract(l, '(?s)(?:^|\\t| ; | \\| )(?:{'|'.join(names)})=(\"(?:[^\"\\\\]|\\\\.)*\")(?:\\t| ; | \\| |$)', 1), '') || ']', '$[0]') END)"
_FACTS = f"""
    WITH lines AS (SELECT line_id, trim(line) AS l FROM triple_lines),
    whole AS (SELECT * FROM lines WHERE l LIKE '{{%' OR regexp_full_match(l, '(?s)(?:\\w+=(?:"(?:[^"\\\\]|\\\\.)*"|\\{{.*?\\}})(?:\\t| ; | \\| |$))+')),
    records AS (SELECT triple_id AS id, head, rel, tail FROM kg_triples
      UNION ALL SELECT line_id, {_VALUE(facts.FIELDS['head'])}, {_VALUE(facts.FIELDS['rel'])}, {_VALUE(facts.FIELDS['tail'])} FROM whole),
    canon AS (SELECT id, nullif(regexp_replace(lower(head), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g'), '') AS head,
      nullif(regexp_replace(lower(rel), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g'), '') AS rel, nullif(regexp_replace(lower(tail), '[^\\p{{L}}\\p{{M}}\\p{{N}}]', '', 'g'), '') AS tail FROM records),
    kept AS (SELECT *, min(id) OVER (PARTITION BY head, rel, tail) AS keep_id FROM canon WHERE head IS NOT NULL AND rel IS NOT NULL AND tail IS NOT NULL)
"""


@query("p6_found", _FACTS + "SELECT keep_id, id AS copy_id FROM kept WHERE id <> keep_id")
def p6_found(spark, d):
    return facts.copies(_records(spark, d))


@query("p6_facts", _FACTS + "SELECT keep_id, head, rel, tail, count(*) AS copies FROM kept GROUP BY ALL")
def p6_facts(spark, d):
    return facts.facts(_records(spark, d))


@query("p4_found")
def p4_found(spark, d):
    return canon.canonical(table(spark, d, "esl_predictions"), table(spark, d, "canon_entries"))


@query("p4_unmatched")
def p4_unmatched(spark, d):
    """The report of unmatched values: how often each was typed, by kind."""
    rows = canon.prediction_values(table(spark, d, "esl_predictions"))
    count = rows.groupBy("kind", "value").agg(F.count("*").alias("times"))
    return canon.map_values(count, table(spark, d, "canon_entries")).where("entry_id = -1").join(count, ["kind", "value"]).select("kind", "value", "times")


#: The words of a text in SQL, as words.words().
_BLANK = "\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}"
_SAID = lambda x: f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}{_BLANK}]', '', 'g'), '[{_BLANK}]+'), lambda w: w <> '')"
#: Of the texts t (id, ws, ...) by brute force: b (id, n, w, c), the bags of their words.
_BAGS = "b AS (SELECT id, n, w, count(*) AS c FROM (SELECT id, len(ws) AS n, unnest(ws) AS w FROM t) GROUP BY ALL)"
_NEAR = "(greatest(x.n, y.n) - least(x.n, y.n)) * 6 <= greatest(x.n, y.n) GROUP BY x.id, y.id, x.n, y.n HAVING (greatest(x.n, y.n) - sum(least(x.c, y.c))) * 6 <= greatest(x.n, y.n)"
_CROSS = f"""WITH t AS (SELECT doc_id AS id, split, source, split = 'train' AS train, {_SAID('text')} AS ws FROM documents WHERE split IN ('train', 'test', 'dev', 'valid', 'val') AND len({_SAID('text')}) >= 20),
    {_BAGS}, pairs AS (SELECT x.id AS train_id, y.id AS other_id FROM b x JOIN b y USING (w) WHERE x.id IN (SELECT id FROM t WHERE train) AND y.id IN (SELECT id FROM t WHERE NOT train) AND {_NEAR})"""


@query("p3_found", f"{_CROSS} SELECT least(train_id, other_id) AS doc_id_a, greatest(train_id, other_id) AS doc_id_b FROM pairs")
def p3_found(spark, d):
    return crosssplit.overlaps(table(spark, d, "documents"))


@query("p3_report", f"{_CROSS} SELECT split, source, count(DISTINCT other_id) AS evaluation_docs, count(*) AS pairs FROM pairs JOIN t ON id = other_id GROUP BY split, source")
def p3_report(spark, d):
    docs = table(spark, d, "documents")
    return crosssplit.report(docs, crosssplit.overlaps(docs))


_CLASSES = f"""WITH RECURSIVE r AS (SELECT row_id, document_id AS doc, {_SAID(f"CASE WHEN regexp_matches(text, '[^{_BLANK}]') THEN text ELSE array_to_string(sentences, ' ') END")} AS ws FROM re_documents WHERE document_id IS NOT NULL),
    m AS (SELECT DISTINCT doc, ws, min(row_id) OVER (PARTITION BY ws) AS cls FROM r WHERE len(ws) >= 40), t AS (SELECT DISTINCT cls AS id, ws FROM m), {_BAGS},
    near AS (SELECT x.id AS a, y.id AS b FROM b x JOIN b y USING (w) WHERE x.id < y.id AND {_NEAR}), links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near)"""


@query(
    "p5_found",
    f"""{_CLASSES}, ends AS (SELECT x.doc AS x, y.doc AS y FROM near JOIN m x ON x.cls = a JOIN m y ON y.cls = b UNION ALL SELECT x.doc, y.doc FROM m x JOIN m y ON x.cls = y.cls WHERE x.doc < y.doc)
    SELECT DISTINCT least(x, y) AS document_id_a, greatest(x, y) AS document_id_b FROM ends WHERE x <> y""",
)
def p5_found(spark, d):
    return nearsame.near_pairs(table(spark, d, "re_documents"))


@query(
    "p5_groups",
    f"""{_CLASSES}, reach AS (SELECT DISTINCT a AS node, a AS other FROM links UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
    SELECT doc AS document_id, cls AS class_id, coalesce((SELECT min(other) FROM reach WHERE node = cls), cls) AS group_id, (SELECT count(*) FROM links WHERE a = cls) AS links FROM m""",
)
def p5_groups(spark, d):
    return nearsame.near_groups(table(spark, d, "re_documents"))


def _leaks(spark, d):
    return leak.leaks(table(spark, d, "documents").where("split = 'train'"), table(spark, d, "eval_passages"))


@query("p7_found")
def p7_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id")


@query("p7_items")
def p7_items(spark, d):
    """Which items leaked: the number of training documents that hold each, and the largest share of it that one holds."""
    found = _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("share").alias("largest_share"))
    return found.join(table(spark, d, "eval_passages").select("item_id", "benchmark"), "item_id")


@query("p8_mixture")
def p8_mixture(spark, d):
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@query("p8_shares")
def p8_shares(spark, d):
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


@query("p8_holds", "SELECT source, true AS reached, true AS within FROM mix_targets WHERE source IS NOT NULL")
def p8_holds(spark, d):
    """Whether each source's share is within 1 % of what it should be among the sources that have text, and none of its documents is used
    too often."""
    targets = table(spark, d, "mix_targets")
    drawn, shares = mix.mixture(table(spark, d, "documents"), targets)
    most = drawn.groupBy("source").agg(F.max("copies").alias("copies"))
    return shares.join(most, "source", "left").select("source", (F.abs(F.col("actual_share") - F.col("wanted_share")) < 0.01).alias("reached"), (F.coalesce("copies", F.lit(0)) <= F.col("max_repeats")).alias("within"))


@query("p9_found")
def p9_found(spark, d):
    return level.levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "level")


@query("p9_profile")
def p9_profile(spark, d):
    """Documents by source and level."""
    found = level.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return found.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count("*").alias("documents"))
