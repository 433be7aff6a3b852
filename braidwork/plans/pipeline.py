"""The retrieval-to-answer pipeline for a batch of tasks, and a run from a configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.functions import answers, text as txt
from braidwork.operators import chunks, relations, retrieve, strategies
from braidwork.sources import files, sinks

Retriever = Callable[[DataFrame], DataFrame]

#: Roles of the model in each kind of task.
ROLES = {
    "question_answering": "Answer from the evidence only and cite the bracketed references. If it does not suffice, answer exactly: INSUFFICIENT EVIDENCE.",
    "summarization": "Summarise faithfully, with facts of the evidence only, citing the bracketed references.",
    "claim_verification": "Compare a claim with the evidence. Reply with two lines: LABEL: SUPPORTS, REFUTES or NOT_ENOUGH_INFO, then RATIONALE: one sentence.",
    "relation_extraction": strategies.SYSTEM,
}


def instructions() -> Column:
    """What each kind of task asks, from task_type, query and max_sentences."""
    q, kind = F.coalesce("query", F.lit("")), F.col("task_type")
    focus = F.when(q != "", F.concat(F.lit(" Focus on: "), q, F.lit("."))).otherwise("")
    return (
        F.when(kind == "question_answering", F.concat(F.lit("Question: "), q, F.lit("\nAnswer concisely with citations.")))
        .when(kind == "summarization", F.concat(F.lit("Summarise the evidence in at most "), F.col("max_sentences").cast("string"), F.lit(" sentences."), focus))
        .when(kind == "claim_verification", F.concat(F.lit("Claim: "), q, F.lit("\nDoes the evidence support or refute it?")))
        .otherwise(q)
    )


def messages() -> Column:
    role = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv)), F.col("task_type")), F.lit("Use only the provided evidence."))
    return F.array(F.struct(F.lit("system").alias("role"), role.alias("content")), F.struct(F.lit("user").alias("role"), F.concat(F.lit("Evidence:\n"), F.coalesce("evidence", F.lit("(no evidence retrieved)")), F.lit("\n\n"), instructions()).alias("content")))


def parsed() -> Column:
    """The output of each kind of task from the raw answer, as JSON or text."""
    claim = F.to_json(F.struct(txt.claim_label("raw").alias("label"), F.coalesce(txt.rationale("raw"), F.lit("")).alias("rationale")))
    return F.when(F.col("task_type") == "claim_verification", claim).when(F.col("task_type") == "relation_extraction", F.to_json(F.coalesce(answers.relations(answers.json_object("raw")), F.create_map().cast("map<string,array<array<string>>>")))).otherwise(F.trim("raw"))


@dataclass
class Pipeline:
    """STR18: retriever -> messages -> client -> output, evaluator and exporters being optional; a pipeline without client is refused."""

    client: strategies.Client | None
    retriever: Retriever | None = None
    evaluator: Callable[[DataFrame], DataFrame] | None = None
    exporters: tuple[Callable[[DataFrame], None], ...] = ()

    def run(self, tasks: DataFrame) -> DataFrame:
        """(task_id, task_type, output, raw, n_evidence, evidence[, metrics]) of tasks (task_id, task_type, query, ...); the model is called
        once per task, before the evaluator and the exporters read the answers."""
        if self.client is None:
            raise ValueError("a pipeline needs a client")
        have = set(tasks.columns)
        df = tasks if "max_sentences" in have else tasks.withColumn("max_sentences", F.lit(5))
        if self.retriever is not None:
            spans = self.retriever(df.select(F.col("task_id").alias("query_id"), F.coalesce("query", F.lit("")).alias("query")))
            said = strategies.evidence_lines(spans.withColumnRenamed("query_id", "task_id"), "task_id")
            n = spans.groupBy(F.col("query_id").alias("task_id")).agg(F.count("*").alias("n_evidence"))
            df = df.join(said, "task_id", "left").join(n, "task_id", "left")
        else:
            df = df.withColumns({"evidence": F.lit(None).cast("string"), "n_evidence": F.lit(None).cast("bigint")})
        df = strategies.generate(df, messages(), self.client)
        out = df.withColumn("output", parsed()).select("task_id", "task_type", "output", "raw", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), "evidence")
        if self.evaluator is not None:
            out = out.join(self.evaluator(out), "task_id", "left")
        for export in self.exporters:
            export(out)
        return out


def dense(documents: DataFrame, k: int = 5) -> Retriever:
    """RET6: a retriever over documents (id, text): one chunk each, hashed vectors."""
    index = chunks.whole(documents)

    def find(queries: DataFrame) -> DataFrame:
        best = retrieve.nearest(queries.withColumnRenamed("query", "text"), index, "query_id", "chunk_id", "text", k)
        return best.join(index.select("chunk_id", "document_id", "text"), "chunk_id")

    return find


def hybrid(parts: list[Retriever], k: int = 5) -> Retriever:
    """RET7: rank fusion of retrievers over spans of document, chunk and text."""
    if not parts:
        raise ValueError("a hybrid retriever needs at least one retriever")

    def find(queries: DataFrame) -> DataFrame:
        return retrieve.fuse([p(queries) for p in parts], ["document_id", "chunk_id", "text"], "query_id", k)

    return find


def evaluate_files(spark: SparkSession, gold: str, predictions: str, ignore: tuple[str, ...] = (), types: str | list[str] = "all") -> tuple[DataFrame, DataFrame]:
    """The evaluation of files: (scores with a row in total and one per relation, counts of documents)."""
    from braidwork.functions.text import first_id
    from braidwork.operators.filters import of_type, without_labels

    pred = of_type(files.json_lines(spark, predictions).where("_corrupt IS NULL"), types).withColumn("document_id", first_id("document_id", "id")).where("document_id IS NOT NULL")
    both = relations.evaluated_documents(pred, files.gold_relations(spark, gold))
    kept = both.where("has_gold")
    sides = [without_labels(relations.triples(kept, c), ignore) for c in ("relations", "pred_relations")]
    return relations.rollup(relations.matched(*sides)), relations.coverage(both)


def run_config(spark: SparkSession, settings: dict, client: strategies.Client) -> DataFrame:
    """A run as a configuration tells: documents, task_type, queries, top_k, output; writes results, metrics and manifest if output is
    given."""
    docs = files.documents(spark, settings["documents"])
    tasks = spark.createDataFrame([(i, settings.get("task_type", "question_answering"), q) for i, q in enumerate(settings.get("queries") or [None])], "task_id int, task_type string, query string")
    out = Pipeline(client, dense(docs, settings.get("top_k", 5))).run(tasks)
    if settings.get("output"):
        metrics = out.agg(F.count("*").alias("tasks"), F.avg("n_evidence").alias("mean_evidence"))
        manifest = spark.range(1).select(F.lit(str(sorted(settings.items()))).alias("config"), txt.iso_utc(F.current_timestamp()).alias("started_at"))
        sinks.run_files(out, metrics, manifest, settings["output"])
    return out
