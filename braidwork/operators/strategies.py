"""Relation extraction by prompting: context, messages, generation, parsing and mapping of ends, for whole tables of documents.

A strategy is a chain of columns: everything up to the messages and after the answers stays declarative; only the model call leaves
the JVM, in Arrow batches, after all filters and slices.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions import answers, text as txt
from braidwork.operators import relations
from braidwork.operators.filters import well_formed
from braidwork.session import stage

Client = Callable[[list[dict]], str]

SYSTEM = "Extract relations between the entities of a document. Answer with one JSON object that maps each relation type to a list of [head_id, tail_id] pairs."
CRITIC = "Name relations that the draft misses. Answer with one JSON object of the same form that holds only the missing pairs."
VERIFY = "Remove pairs that the document does not support. Answer with one JSON object of the same form."
REASON = "Think step by step about which entities of the document are related and how. Do not answer with JSON yet."


def echo(messages: list[dict]) -> str:
    """A stand-in for a model: the last message."""
    return messages[-1]["content"] if messages else ""


def fixed(reply: str) -> Client:
    """A stand-in that always gives one answer."""
    return lambda messages: reply


def message(role: str, *parts: Column | str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("content"))


def generate(df: DataFrame, messages: Column, client: Client, out: str = "raw") -> DataFrame:
    """STR0: a column of answers of client, a function from messages to text, called once a row; null messages get no call.

    The calls are made here, and the rows with their answers written to the shared folder: whatever reads them later, and however often, makes
    no call again."""

    @F.pandas_udf("string")
    def call(batch: pd.Series) -> pd.Series:
        return batch.map(lambda m: client(json.loads(m)) if m is not None else None)

    return stage(df.withColumn(out, call(F.to_json(messages))))


def entity_lines(most: int | None = None, mentions: int | None = None) -> Column:
    """SCA6, WIN12: a line per entity: id, its mentions, its type; the first `most` entities with their first `mentions` mentions, in input order."""

    def line(k: Column, e: Column) -> Column:
        given = F.coalesce(e["mentions"], F.array().cast(MENTIONS))
        names = F.array_distinct(F.filter(F.transform(given if mentions is None else F.slice(given, 1, mentions), lambda m: F.coalesce(F.nullif(m["trigger_word"], F.lit("")), F.nullif(m["text"], F.lit("")))), lambda t: t.isNotNull()))
        kind = F.coalesce(F.nullif(e["type"], F.lit("")), F.lit(""))
        return F.concat(F.lit("- "), k, F.lit(': "'), F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise(k), F.lit('"'), F.when(kind != "", F.concat(F.lit(" ["), kind, F.lit("]"))).otherwise(""))

    entries = F.map_entries("entities")
    rows = F.transform(entries if most is None else F.slice(entries, 1, most), lambda x: line(x["key"], x["value"]))
    return F.when(F.size(rows) > 0, F.array_join(rows, "\n")).otherwise("(no entities provided)")


def relation_lines(relations_: Column | str, pairs: int = 6, total: int = 20) -> Column:
    """WIN12: a line `head rel tail` for each pair of a map from relation to pairs: the first `pairs` of each relation, the first `total` of all;
    pairs that aren't two strings go first."""
    entries = F.map_entries(F.col(relations_) if isinstance(relations_, str) else relations_)
    fine = lambda v: F.slice(F.filter(F.coalesce(v, F.array().cast("array<array<string>>")), well_formed), 1, pairs)
    lines = F.flatten(F.transform(entries, lambda x: F.transform(fine(x["value"]), lambda p: F.concat_ws(" ", F.lit("-"), p[0], x["key"], p[1]))))
    return F.array_join(F.slice(F.coalesce(lines, F.array().cast("array<string>")), 1, total), "\n")


MENTIONS = "array<struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int,token_id:int,offset:array<int>>>"


def evidence_lines(ranked: DataFrame, key: str) -> DataFrame:
    """SCA6: (key, evidence): ranked spans (key, rank, document_id, text and optionally chunk_id) as lines in rank order."""
    chunk = F.when(F.col("chunk_id").isNotNull(), F.concat(F.lit("/"), F.col("chunk_id").cast("string"))).otherwise("") if "chunk_id" in ranked.columns else F.lit("")
    line = F.concat(F.lit("["), F.col("document_id").cast("string"), chunk, F.lit("] "), F.coalesce("text", F.lit("")))
    return ranked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("evidence"))


def document_text() -> Column:
    return F.coalesce(F.when(F.col("text").rlike(r"(?U)\S"), F.col("text")), F.array_join("sentences", " "), F.lit(""))


def pruned_types(documents: DataFrame, most: int = 20, least: int = 6) -> DataFrame:
    """WIN8: (document_id, prompt_types): the relation types shown in the prompt: all if there are at most `most`, else those with most label
    words in the document (+ .05 a word), ties to the larger name."""
    said = F.lower(F.concat_ws(" ", "title", document_text(), F.coalesce("context", F.lit("")) if "context" in documents.columns else F.lit("")))
    words = lambda r: txt.label_tokens(r)
    score = lambda r: F.when(F.size(words(r)) > 0, F.size(F.filter(words(r), lambda w: F.contains(F.col("_said"), w))) + 0.05 * F.size(words(r))).otherwise(0.0)
    d = documents.withColumn("_said", said)
    best = F.transform(F.slice(F.reverse(F.array_sort(F.transform("types", lambda r: F.struct(score(r).cast("double").alias("s"), r.alias("r"))))), 1, max(most, least)), lambda x: x["r"])
    return d.select("document_id", F.when(F.size("types") <= most, F.col("types")).otherwise(best).alias("prompt_types"))


def rule_plan(entities: int = 8, chars: int = 1200, sentences: int = 15, web: bool = False, wikidata: bool = False) -> dict[str, Column]:
    """SCA15: whether to look things up: enabled, many entities, and a long document."""
    long = (F.length(F.coalesce("text", F.lit(""))) > chars) | (F.coalesce(F.size("sentences"), F.lit(0)) > sentences)
    useful = (F.coalesce(F.size("entities"), F.lit(0)) >= entities) & long
    return {"do_web": F.lit(web) & useful, "do_wikidata": F.lit(wikidata) & useful}


@dataclass(frozen=True)
class Strategy:
    """How a strategy differs: the name of its context, its model calls and how ends are mapped."""

    name: str
    context: str | None = None
    ends: str | None = None
    calls: tuple[str, ...] = ("extract",)
    prune: bool = False
    alias: bool = False
    need_links: bool = False
    caps: tuple[int | None, int | None] = (None, None)
    extra: dict = field(default_factory=dict)


#: STR1-STR13: contexts are frames (document_id, context) made by the retrieval operators.
STRATEGIES = {
    s.name: s
    for s in (
        Strategy("baseline", alias=True),
        Strategy("icl", context="few_shots"),
        Strategy("cot", calls=("reason", "extract")),
        Strategy("kg_rag", context="kg"),
        Strategy("triple_kg_rag", context="triples"),
        Strategy("community_kg_rag", context="communities", prune=True),
        Strategy("og_rag", context="lines", ends="surface_first"),
        Strategy("grow_rag", context="subontology", ends="strict_tail_literal", need_links=True, caps=(12, 2)),
        Strategy("chunk_rag", context="chunks", ends="keep_unresolved"),
        Strategy("agentic", context="ontology_and_kg"),
        Strategy("agentic_graph", context="ontology_and_kg", ends="strict_tail_literal", extra={"lookups": True}),
        Strategy("agentic_simple", context="lookups", ends="both_in_set", extra={"lookups": True}),
        Strategy("marag", context="ontology_and_kg", ends="strict_tail_literal", calls=("extract", "critic", "verify")),
    )
}


def prompt(types: Column, context: Column | None, draft: Column | None = None, reasoning: Column | None = None, task: str = SYSTEM, caps: tuple[int | None, int | None] = (None, None)) -> Column:
    parts: list[Column | str] = [F.concat(F.lit("Relation types: "), F.array_join(types, ", ")), "Entities:", entity_lines(*caps)]
    if context is not None:
        parts += ["Context:", txt.truncated(context)]
    if reasoning is not None:
        parts += ["Reasoning:", reasoning]
    if draft is not None:
        parts += ["Draft:", draft]
    return F.array(message("system", task), message("user", *parts, "Document:", document_text()))


def run(documents: DataFrame, strategy: str | Strategy, client: Client, context: DataFrame | None = None, types: list[str] | None = None, budget: int = 3) -> DataFrame:
    """STR1-STR13, STR17: (document_id, pred_relations, calls, raw): the predictions of a strategy for documents (one row per
    document_id), the model being called exactly `calls` times for each.  context is (document_id, context); documents without one are prompted without, unless the strategy needs links: then
    all their types are empty and no call is made."""
    s = STRATEGIES[strategy] if isinstance(strategy, str) else strategy
    df = documents.withColumn("types", txt.relation_types(types, "relations"))
    if context is not None:
        df = df.join(context.select("document_id", "context"), "document_id", "left")
    elif "context" not in df.columns:
        df = df.withColumn("context", F.lit(None).cast("string"))
    df = df.join(pruned_types(df), "document_id") if s.prune else df.withColumn("prompt_types", F.col("types"))
    ask = F.col("ontology_links").isNotNull() if s.need_links else F.lit(True)
    ctx = F.col("context") if s.context else None
    if "reason" in s.calls:
        df = generate(df, F.when(ask, prompt(F.col("prompt_types"), ctx, task=REASON, caps=s.caps)), client, "reasoning")
    df = generate(df, F.when(ask, prompt(F.col("prompt_types"), ctx, reasoning=F.col("reasoning") if "reason" in s.calls else None, caps=s.caps)), client)
    read = (lambda c: answers.by_alias(answers.relations(c), "types")) if s.alias else (lambda c: answers.normalised(F.coalesce(answers.relations(answers.json_object(c)), F.create_map().cast("map<string,array<array<string>>>")), "types"))
    df = df.withColumn("pred", read("raw"))
    calls = 1 + ("reason" in s.calls)
    if "critic" in s.calls and budget > calls:
        df = generate(df, prompt(F.col("prompt_types"), ctx, draft=F.to_json("pred"), task=CRITIC, caps=s.caps), client, "gaps").withColumn("more", read("gaps"))
        df = df.withColumn("pred", F.map_from_arrays("types", F.transform("types", lambda t: F.array_distinct(F.concat(F.try_element_at("pred", t), F.try_element_at("more", t))))))
        calls += 1
    if "verify" in s.calls and budget > calls:
        df = generate(df, prompt(F.col("prompt_types"), ctx, draft=F.to_json("pred"), task=VERIFY, caps=s.caps), client, "checked")
        df = df.withColumn("pred", F.when(answers.json_object("checked").isNotNull(), read("checked")).otherwise(F.col("pred")))
        calls += 1
    out = df.select("document_id", "types", F.coalesce("pred", answers.normalised(F.create_map().cast("map<string,array<array<string>>>"), "types")).alias("pred_relations"), F.when(ask, calls).otherwise(0).alias("calls"), "raw")
    if s.ends is None:
        return out.drop("types")
    pairs = relations.triples(out, "pred_relations")
    mapped = relations.as_maps(answers.ends(pairs, documents, s.ends), column="mapped")
    none = F.create_map().cast("map<string,array<array<string>>>")
    return out.join(mapped, "document_id", "left").select("document_id", answers.normalised(F.coalesce("mapped", none), "types").alias("pred_relations"), "calls", "raw")


def same_sentence(events: DataFrame) -> DataFrame:
    """STR14, JN16: (doc_id, source, target, relation): every two events (doc_id, sentence, pos, event_id, event_class) of a sentence,
    in order, as PRECONDITION; classes that name no event are left out."""
    kept = events.where(~F.coalesce(F.col("event_class"), F.lit("")).isin(*NO_EVENT))
    a, b = kept.alias("a"), kept.alias("b")
    on = [F.col("a.doc_id") == F.col("b.doc_id"), F.col("a.sentence") == F.col("b.sentence"), F.col("a.pos") < F.col("b.pos")]
    return a.join(b, on).select(F.col("a.doc_id").alias("doc_id"), F.col("a.event_id").alias("source"), F.col("b.event_id").alias("target"), F.lit("PRECONDITION").alias("relation"))


# Markable classes that are no events.
NO_EVENT = ("TIME_DATE", "TIME_DURATION", "TIME_OF_THE_DAY", "TIME_REPETITION", "LOC_GEO", "LOC_FAC")


def cooccurrences(events: DataFrame) -> DataFrame:
    """AGG18, JN16: (a, b, n): how often two lemmas occur in a document, the first before the second; loops count."""
    a, b = events.alias("a"), events.alias("b")
    both = a.join(b, [F.col("a.doc_id") == F.col("b.doc_id"), F.col("a.pos") < F.col("b.pos")])
    return both.groupBy(F.col("a.lemma").alias("a"), F.col("b.lemma").alias("b")).agg(F.count("*").alias("n"))


def ppmi(pairs: DataFrame, low: float = 0.4, high: float = 0.763, as_text: bool = False) -> DataFrame:
    """STR15, AGG17: positive pointwise mutual information of pairs (a, b, n), scaled to 0..1, those from low to high.  as_text takes the
    smallest and largest value by their digits, as the official script does (B12)."""
    total = pairs.agg(F.sum("n").alias("total"))
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    scored = pairs.join(left, "a").join(right, "b").join(total).select("a", "b", "n", F.greatest(F.lit(0.0), F.log2(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("ppmi"))
    x = F.col("ppmi").cast("string") if as_text else F.col("ppmi")
    ends = scored.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    scaled = scored.join(ends).withColumn("scaled", F.when(F.col("hi") > F.col("lo"), (F.col("ppmi") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    return scaled.where(F.col("scaled").between(low, high)).select("a", "b", "n", "ppmi", "scaled")


def in_containers(pairs: DataFrame, contained: DataFrame) -> DataFrame:
    """STR16, JN17: pairs (doc_id, source, target) whose events lie in one time container (doc_id, event_id, container)."""
    s, t = contained.toDF("doc_id", "source", "sc").distinct(), contained.toDF("doc_id", "target", "tc").distinct()
    return pairs.join(s, ["doc_id", "source"]).join(t, ["doc_id", "target"]).where("sc = tc").drop("sc", "tc").distinct()
