"""Structured Streaming: evaluation that follows arriving predictions, and windowed counts of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from braidwork.operators import filters, relations
from braidwork.session import shared_dir


def file_stream(spark: SparkSession, directory: str, schema, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(directory)


def follow_predictions(stream: DataFrame, counts_path: str, checkpoint: str) -> StreamingQuery:
    """Counts of each document (document_id, relations, pred_relations, row_id, ingested_at) as its deliveries arrive, written batch by
    batch; a batch is written once even if it is run again, as its folder is replaced."""

    def write(batch: DataFrame, number: int) -> None:
        docs = filters.latest(batch)
        pairs = relations.matched(relations.triples(docs), relations.triples(docs, "pred_relations"))
        per = relations.per_document(pairs).select("document_id", "tp", "fp", "fn")
        seen = docs.select("document_id", "row_id", "ingested_at").join(per, "document_id", "left").fillna(0, ["tp", "fp", "fn"])
        seen.write.mode("overwrite").parquet(f"{counts_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores(spark: SparkSession, counts_path: str) -> DataFrame:
    """Micro scores of what arrived so far: of each document the counts of its latest delivery, added up."""
    last = filters.latest(spark.read.parquet(counts_path))
    return relations.scores(last.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))))


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Streams need an instant for their watermark; a time without zone is taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) in tumbling windows, rows later than `late` being dropped; batch or stream."""
    out = _watermarked(events, late)
    return out.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of users (user_id, ts): runs of events with pauses below gap; batch or stream."""
    out = _watermarked(events, late)
    return out.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def run_to_end(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a streaming frame over all that is there, each batch written to a folder `name` of the shared folder, with the stream's state beside
    it; in complete mode the last batch is the result, else all of them are."""
    at = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    batches: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/result/batch={number}")
        batches.append(number)

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not batches:
        return df.sparkSession.createDataFrame([], df.schema)
    kept = batches[-1:] if mode == "complete" else batches
    return df.sparkSession.read.schema(df.schema).parquet(*(f"{at}/result/batch={n}" for n in kept))
