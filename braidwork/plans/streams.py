"""Queries that run as streams, and converters over stand-ins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from braidwork.operators import convert
from braidwork.plans.evaluation import LATEST, MATCHED, ROUND, documents, rounded
from braidwork.plans.registry import query
from braidwork.session import shared_dir
from braidwork.sources.tables import table
from braidwork.streaming import incremental


MICROS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S.%f') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    """Hourly counts of events read as a stream; its result is one row per hour and type."""
    stream = incremental.file_stream(spark, f"{d}/events.parquet", table(spark, d, "events").schema)
    return incremental.run_to_end(incremental.windowed(stream), f"w{uuid.uuid4().hex}").withColumn("start", F.date_format("start", MICROS))


@query(
    "event_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events),
    s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_sessions(spark, d):
    return incremental.sessions(table(spark, d, "events")).withColumn("start", F.date_format("start", MICROS))


@query("stream_evaluation", f"{MATCHED} SELECT *, {ROUND} FROM (SELECT (SELECT count(*) FROM docs) AS documents, count(*) FILTER (in_gold AND in_pred) AS tp, count(*) FILTER (in_pred AND NOT in_gold) AS fp, count(*) FILTER (in_gold AND NOT in_pred) AS fn FROM matched)")
def stream_evaluation(spark, d):
    """Predictions evaluated as they arrive, re-deliveries replacing what came before; the sums equal those of a batch."""
    at = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    stream = incremental.file_stream(spark, f"{d}/re_documents.parquet", table(spark, d, "re_documents").schema)
    incremental.follow_predictions(stream, f"{at}/counts", f"{at}/state").awaitTermination()
    return rounded(incremental.scores(spark, f"{at}/counts"), "precision", "recall", "f1")


_MAVEN = f"""WITH {LATEST}, k AS (SELECT document_id AS raw_id, text, title, relations, list_filter(map_keys(entities), lambda e: e <> '') AS ids FROM docs WHERE len(sentences) > 0 AND len(list_filter(sentences, lambda s: s IS NULL)) = 0 AND entities IS NOT NULL AND title <> ''),
  r AS (SELECT raw_id, ids, x.key AS rel, x.value AS v FROM (SELECT raw_id, ids, unnest(map_entries(relations)) AS x FROM k)),
  p AS (SELECT raw_id, rel, p[1] AS head, p[2] AS tail FROM (SELECT raw_id, ids, rel, unnest(v) AS p FROM r) WHERE len(p) = 2 AND list_contains(ids, p[1]) AND list_contains(ids, p[2]))"""


@query("convert_maven", f"{_MAVEN} SELECT title, rel, head, tail FROM p JOIN k USING (raw_id)")
def convert_maven(spark, d):
    """Documents taken for raw ones: their entities as events, their relations as causal ones."""
    from braidwork.operators.relations import triples

    docs = documents(spark, d).where("size(sentences) > 0 AND NOT exists(sentences, s -> s IS NULL) AND entities IS NOT NULL AND title <> ''")
    mention = "array<struct<id:string,trigger_word:string,sent_id:int,offset:array<int>>>"
    events = F.transform(F.map_entries("entities"), lambda e: F.struct(e["key"].alias("id"), e["value"]["type"].alias("type"), F.transform(e["value"]["mentions"], lambda m: F.struct(m["id"].alias("id"), m["trigger_word"].alias("trigger_word"), m["sent_id"].alias("sent_id"), m["offset"].alias("offset"))).cast(mention).alias("mention")))
    raw = docs.select(F.col("type").alias("split"), "title", "sentences", F.lit(None).cast("array<array<string>>").alias("tokens"), events.alias("events"), F.col("relations").alias("causal_relations"))
    return triples(convert.maven(raw), key="title").select("title", "rel", "head", "tail")


_STEM = "regexp_replace(lower(w), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')"


@query(
    "causal_stems",
    f"""SELECT item_id, CASE WHEN t LIKE '%ing' AND length(t) > 5 THEN t[:-4] WHEN t LIKE '%ed' AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%ly' AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%es' AND length(t) > 4 THEN t[:-3] WHEN t LIKE '%s' AND length(t) > 3 THEN t[:-2] ELSE t END AS stem
    FROM (SELECT item_id, {_STEM} AS t FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS w FROM eval_passages))""",
)
def causal_stems(spark, d):
    w = table(spark, d, "eval_passages").select("item_id", F.explode(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("w"))
    return w.select("item_id", convert.stem(F.col("w")).alias("stem"))


