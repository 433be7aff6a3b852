"""Answers, ends, prompts and strategies."""

import json

import pytest
from pyspark.sql import functions as F

from braidwork.functions import answers
from braidwork.operators import relations, strategies
from braidwork.plans.pipeline import Pipeline, dense, hybrid

ENT = "map<string,struct<type:string,lemma:string,mentions:array<struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int,token_id:int,offset:array<int>>>>>"
DOC = f"document_id string, title string, text string, sentences array<string>, entities {ENT}, relations map<string,array<array<string>>>, ontology_links struct<a:int>"
m = lambda t: (None, t, None, None, None, None, None, None)


def docs(spark):
    ents = {"E1": ("T", None, [m("Pump"), m("unit")]), "E2": ("", None, [m("seal")]), "E3": (None, None, [m(" PUMP ")]), "E4": (None, None, None)}
    return spark.createDataFrame([("d1", "t", "the text", None, ents, {"CAUSES": [["E1", "E2"]]}, (1,)), ("d2", None, None, ["a", "b"], {}, {"R": []}, None)], DOC)


def test_first_json():
    f = answers.first_json_text
    assert f('x {"a": {"b": 1}} y {"c": 2}') == '{"a":{"b":1}}' and f("```json\n[1, 2]\n```") == "[1,2]" and f("7") == "7"
    assert f("{bad} {\"ok\": 1}") == '{"ok":1}' and f("none") is None and f(None) is None and f('```{"a":1}``` {"b":2}') == '{"a":1}'


def test_objects_and_relations(spark):
    raw = ['{"CAUSES":[["E1","E2"],["only-one"],"junk",["E1",42],["E3","E4"]],"X":3,"Y":null}', "```json\n{\"A\": []}\n```", "so {\"A\": [[\"x\", \"y\"]]} there", "[1]", "", None, "{cut"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string")
    got = {x.i: x.m for x in df.select("i", answers.normalised(F.coalesce(answers.relations(answers.json_object("r")), F.create_map().cast("map<string,array<array<string>>>")), F.array(F.lit("CAUSES"), F.lit("A"))).alias("m")).collect()}
    assert got[0] == {"CAUSES": [["E1", "E2"], ["E3", "E4"]], "A": []} and got[1] == {"CAUSES": [], "A": []} and got[2]["A"] == [["x", "y"]]
    assert all(got[k] == {"CAUSES": [], "A": []} for k in (3, 4, 5, 6))
    alias = spark.createDataFrame([({"P17": [["a", "b"]], " country ": [["c", "d"]], "COUNTRY": [["e", "f"]], "other": [["g", "h"]]},)], "m map<string,array<array<string>>>")
    out = alias.select(answers.by_alias("m", F.array(F.lit("P17 : country"), F.lit("Q : x"))).alias("m")).first().m
    assert sorted(out["P17 : country"]) == [["a", "b"], ["c", "d"], ["e", "f"]] and out["Q : x"] == []


def test_ends(spark):
    d = docs(spark)
    pairs = spark.createDataFrame([("d1", "R", i, h, t) for i, (h, t) in enumerate([("E1", "E2"), ("E1", "Seal"), ("seal", "E1"), ("E1", "pump"), ("E1", "nowhere"), ("E2", "E3"), ("pump", "seal"), ("E1", "E1"), (" x ", "y"), ("", "y")])], "document_id string, rel string, pos int, head string, tail string")
    got = lambda v: sorted((r.pos, r.head, r.tail) for r in answers.ends(pairs, d, v).collect())
    assert got("both_in_set") == [(0, "E1", "E2"), (5, "E2", "E3"), (7, "E1", "E1")]
    assert got("strict_tail_literal") == [(0, "E1", "E2"), (1, "E1", "E2"), (5, "E2", "E3"), (7, "E1", "E1")]
    won = {r.key: r.entity_id for r in answers.surfaces(d).collect()}["pump"]
    assert won in ("E1", "E3")
    assert (6, won, "E2") in got("surface_first") and all(h != t for _, h, t in got("surface_first"))
    assert len(got("keep_unresolved")) == 9 and (8, "x", "y") in got("keep_unresolved")
    with pytest.raises(ValueError, match="variant"):
        answers.ends(pairs, d, "what")


def test_strategies(spark):
    d = docs(spark)
    gold = lambda msgs: json.dumps({"CAUSES": [["E1", "E2"], ["E1", "Seal"]]})
    for name, s in strategies.STRATEGIES.items():
        ctx = d.select("document_id", F.lit("ctx").alias("context")) if s.context else None
        out = {r.document_id: r for r in strategies.run(d, name, gold, ctx).collect()}
        assert out["d1"].pred_relations["CAUSES"][0] == ["E1", "E2"] and out["d2"].pred_relations == {"R": []}, name
        n = {None: 2, "strict_tail_literal": 2, "both_in_set": 1, "surface_first": 2, "keep_unresolved": 2}[s.ends]
        assert len(out["d1"].pred_relations["CAUSES"]) == n, name
        assert out["d1"].calls == {"cot": 2, "marag": 3}.get(name, 1) and out["d2"].calls == (0 if s.need_links else out["d1"].calls)
    assert strategies.run(d, "marag", gold, budget=1).first().calls == 1
    empty = strategies.run(d, "baseline", strategies.fixed("no json"), types=["A", "B"]).first().pred_relations
    assert empty == {"A": [], "B": []}
    seen = strategies.run(d, "kg_rag", strategies.echo, d.select("document_id", F.lit("CTX").alias("context"))).where("document_id = 'd1'").first().raw
    assert "CTX" in seen and '- E2: "seal"' in seen and '- E1: "Pump, unit" [T]' in seen and "the text" in seen


def test_gold_echo_scores_one(spark):
    d = docs(spark)
    ctx = d.select("document_id", F.to_json("relations").alias("context"))
    out = strategies.run(d, "kg_rag", lambda ms: ms[-1]["content"].partition("Context:\n")[2].partition("\nDocument:")[0], ctx)
    r = relations.micro(relations.matched(relations.triples(d), relations.triples(out, "pred_relations"))).first()
    assert r.f1 == 1.0


def test_pruning_and_plan(spark):
    d = docs(spark).withColumn("types", F.array(*(F.lit(f"r{i} : {w}") for i, w in enumerate(["text", "zebra", "lion"])))).withColumn("context", F.lit(None).cast("string"))
    got = {r.document_id: r.prompt_types for r in strategies.pruned_types(d, 1, 1).collect()}
    assert got["d1"] == ["r0 : text"] and got["d2"] == ["r2 : lion"] or got["d2"] == ["r1 : zebra"]
    assert strategies.pruned_types(d, 20).first().prompt_types == ["r0 : text", "r1 : zebra", "r2 : lion"]
    plan = d.select("document_id", *(c.alias(n) for n, c in strategies.rule_plan(entities=3, chars=5, web=True).items())).collect()
    assert {(r.document_id, r.do_web, r.do_wikidata) for r in plan} == {("d1", True, False), ("d2", False, False)}


def test_baselines(spark):
    e = spark.createDataFrame([("d", 0, 1, "a", None, "x"), ("d", 0, 2, "b", None, "y"), ("d", 0, 3, "t", "TIME_DATE", "z"), ("d", 1, 1004, "c", None, "x")], "doc_id string, sentence int, pos int, event_id string, event_class string, lemma string")
    assert [(r.source, r.target) for r in strategies.same_sentence(e).collect()] == [("a", "b")]
    pairs = strategies.cooccurrences(e)
    assert {(r.a, r.b): r.n for r in pairs.collect()} == {("x", "y"): 1, ("x", "z"): 1, ("x", "x"): 1, ("y", "z"): 1, ("y", "x"): 1, ("z", "x"): 1}
    assert strategies.ppmi(pairs, 0.0, 1.0).count() == 6
    text = spark.createDataFrame([("p", "q", 8), ("p", "r", 1), ("s", "r", 9), ("s", "q", 1)], "a string, b string, n bigint")
    assert strategies.ppmi(text, 0.0, 1.0).count() == 4 and strategies.ppmi(text, 0.0, 1.0, as_text=True).count() >= 1
    c = spark.createDataFrame([("d", "a", "t1"), ("d", "b", "t1")], "doc_id string, event_id string, container string")
    assert strategies.in_containers(strategies.same_sentence(e), c).count() == 1


def test_pipeline(spark):
    d = spark.createDataFrame([(1, "the pump failed because of a seal"), (2, "a routine check"), (3, "alarm")], "id int, text string")
    tasks = spark.createDataFrame([(1, "question_answering", "why did the pump fail"), (2, "claim_verification", "pump"), (3, "summarization", None), (4, "relation_extraction", "x")], "task_id int, task_type string, query string")
    find = hybrid([dense(d, 2), dense(d, 1)], 2)
    out = {r.task_id: r for r in Pipeline(strategies.echo, find).run(tasks).collect()}
    assert out[1].evidence.startswith("[1/1-c0] the pump failed") and out[1].n_evidence == 2 and "Question: why" in out[1].output
    assert json.loads(out[2].output) == {"label": "NOT_ENOUGH_INFO", "rationale": ""} and out[4].output == "{}" and "at most 5 sentences" in out[3].raw
    none = Pipeline(strategies.fixed("ok"), evaluator=lambda r: r.select("task_id", F.lit(1.0).alias("metric"))).run(tasks).first()
    assert none.n_evidence == 0 and none.metric == 1.0
    with pytest.raises(ValueError, match="client"):
        Pipeline(None).run(tasks)
    with pytest.raises(ValueError, match="retriever"):
        hybrid([])


def test_contexts(spark):
    from braidwork.operators import graph, ontology
    from braidwork.plans import contexts

    ents = {"E1": ("T", None, [m("Pump")]), "E2": ("", None, [m("seal")])}
    cols = DOC.replace("ontology_links struct<a:int>", f"ontology_links struct<by_entity:map<string,struct<candidates:array<{ontology.CANDIDATE}>,selected:{ontology.CANDIDATE}>>>") + ", row_id bigint, type string"
    rows = [("d1", "t", "pump text", None, ents, {"R": [["E1", "E2"], ["E2", "E1"]]}, None, 1, "train"), ("d2", None, " ", None, {}, {}, None, 2, "train"), ("d3", None, None, ["x"], {}, {"R": [["a", "b"]]}, None, 3, "test")]
    d = spark.createDataFrame(rows, cols)
    edges = graph.gold_edges(d)
    by = lambda df: {r.document_id: r.context for r in df.collect()}
    assert sorted(by(contexts.kg(d, edges))["d1"].split("\n")) == ["- E1 R E2", "- E2 R E1"] and set(by(contexts.triples(d, edges))) == {"d1"}
    shots = by(contexts.few_shots(d, d, 1))
    assert set(shots) == {"d1", "d2", "d3"} and shots["d3"].startswith("Example:\npump text\n{")
    table = spark.createDataFrame([(1, 0, None, "all about pump text here"), (2, 1, 1, "pump text"), (3, 1, 9, "other")], "chunk_id bigint, is_leaf int, parent_id bigint, text string")
    assert by(contexts.ontology_chunks(d, table, 1))["d1"] == "pump text"
    assert by(contexts.ontology_chunks(d, table, 1, merge=2))["d1"] == "all about pump text here"
    linked = spark.createDataFrame([("d1", "E1", 1, "Pump")], "document_id string, entity_id string, rank int, label string")
    both = by(contexts.ontology_and_kg(d, linked, edges, 1))
    assert both["d1"].split("\n")[0] == "E1 is a Pump" and len(both["d1"].split("\n")) == 2 and both["d3"] is None
    found = spark.createDataFrame([(" PUMP", "moves water"), ("seal", "keeps tight"), ("zzz", "no")], "key string, text string")
    assert by(contexts.looked_up(d, found)) == {"d1": "pump: moves water\nseal: keeps tight"}
    embed = lambda df: df.withColumn("vector", F.when(F.contains("text", F.lit("pump")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    texts = spark.createDataFrame([("s1", "pump broke"), ("s2", "calm")], "sentence_id string, text string")
    sent = spark.createDataFrame([("A", "s1", 1), ("B", "s2", 2)], "community string, sentence_id string, pos bigint")
    assert by(contexts.communities(d, sent, embed(texts), texts, embed, top_communities=1))["d1"] == "- pump broke"
