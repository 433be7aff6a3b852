"""Stores, model calls that are counted, stages that are released, and operators that were given caps or bounds."""

import uuid

import pytest
from pyspark.sql import functions as F

from braidwork.functions import embed, text as txt
from braidwork.operators import graph, ontology, retrieve, runtime, store, strategies
from braidwork.plans.pipeline import Pipeline
from braidwork.session import file_state, released, shared_dir, stage, write_text
from braidwork.sources import sinks

DOC = "document_id string, title string, text string, sentences array<string>, entities map<string,struct<type:string,lemma:string,mentions:array<struct<id:string,trigger_word:string,text:string,name:string,sent_id:int,sentence_id:int,token_id:int,offset:array<int>>>>>, relations map<string,array<array<string>>>, ontology_links struct<a:int>"


def test_vector_store(spark, tmp_path):
    s = store.VectorStore(spark, str(tmp_path / "v"), 64)
    rows = lambda xs: spark.createDataFrame(xs, "id string, document_id string, text string")
    with pytest.raises(ValueError, match="stored"):
        s.search(rows([("q", "", "x")]).selectExpr("id AS query_id", "text"))
    assert s.upsert(rows([("a", "d1", "pump seal failure"), ("b", "d2", "alarm"), ("c", "d3", None)])) == 1
    assert s.upsert(rows([("b", "d2", "pump seal"), ("e", "d4", "other words"), ("e", "d4", "other")])) == 2
    assert {r.id: r.text for r in s.rows().collect()} == {"a": "pump seal failure", "b": "pump seal", "c": None, "e": "other words"}
    got = s.search(rows([("q", "", "pump seal")]).selectExpr("id AS query_id", "text"), 2).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a"] and got[0].document_id == "d2"
    assert [r.id for r in s.search(rows([("q", "", "pump seal")]).selectExpr("id AS query_id", "text"), 1, where="id <> 'b'").collect()] == ["a"]
    assert {r.point_id for r in s.rows().where("id = 'a'").collect()} == {str(uuid.uuid5(uuid.UUID(store.NAMESPACE), "a"))}
    assert s.upsert(rows([("a", "d1", "x")])) == 3 and not (tmp_path / "v" / "v=1").exists()


def test_point_ids(spark):
    names = ["", "a", "é", "x" * 500, "c1-c0"]
    got = [r.p for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(store.point_id("n").alias("p")).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(store.NAMESPACE), n)) for n in names]


def test_merge_batches(spark):
    edges = spark.createDataFrame([(f"h{i % 7}", "R", f"t{i}", i, [i]) for i in range(100)], "head string, rel string, tail string, n int, nested array<int>")
    b = store.merge_batches(edges, "edges", 30)
    assert b.count() > 1 and "nested" not in b.first().rows and sum(r.n for r in b.select(F.size(F.from_json("rows", "array<struct<source:string>>")).alias("n")).collect()) == 100
    assert store.merge_batches(edges.limit(0), "edges").count() == 0
    with pytest.raises(ValueError, match="kind"):
        store.merge_batches(edges, "other")


def test_one_call_for_each_that_is_reported(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "t", f"text {i}", None, {"E1": ("T", None, [])}, {"R": [["E1", "E1"]]}, (1,) if i else None) for i in range(6)], DOC)
    for name in strategies.STRATEGIES:
        log = tmp_path / f"{name}.txt"

        def client(messages, log=str(log)):
            with open(log, "a") as f:
                f.write("x\n")
            return '{"R": [["E1", "E1"]]}'

        out = strategies.run(docs, name, client, docs.selectExpr("document_id", "'known' AS context")).collect()
        assert len(out) == 6 and len(log.read_text().splitlines()) == sum(r.calls for r in out), name
    log = tmp_path / "pipeline.txt"

    def answer(messages, log=str(log)):
        with open(log, "a") as f:
            f.write("x\n")
        return "SUPPORTS"

    tasks = spark.createDataFrame([(i, "claim_verification", "q") for i in range(10)], "task_id int, task_type string, query string")
    p = Pipeline(answer, evaluator=lambda o: o.select("task_id", F.lit(1).alias("metrics")), exporters=(lambda o: sinks.json_lines(o, str(tmp_path / "a")), lambda o: sinks.json_lines(o, str(tmp_path / "b"))))
    assert p.run(tasks).count() == 10 and len(log.read_text().splitlines()) == 10


def test_models_load_once_a_task(spark, tmp_path):
    log = str(tmp_path / "loads.txt")

    def load():
        with open(log, "a") as f:
            f.write("x\n")
        return lambda texts: [[len(t or ""), 1.0] for t in texts]

    df = stage(spark.range(70_000).select("id", F.lit("abc").alias("text")).repartition(1))  # one file of seven batches
    assert embed.embed(df, "text", make=load).where("vector[0] = 3").count() == 70_000
    assert len(open(log).read().splitlines()) == 1


def test_stages_are_released(spark):
    with released(spark):
        path = stage(spark.range(3)).inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert file_state(spark, path)[0] > 0
    with pytest.raises(Exception):  # noqa: B017
        file_state(spark, path)


def test_hash_of_a_build_follows_its_file(spark):
    at = f"{shared_dir(spark)}/build-{uuid.uuid4().hex}.txt"
    write_text(spark, at, "one")
    a = runtime.build_hash(spark, at, size=3)
    assert a == runtime.build_hash(spark, at, size=3) != runtime.build_hash(spark, at, size=4)
    write_text(spark, at, "another")
    assert a != runtime.build_hash(spark, at, size=3)


def test_many_items_in_passes(spark):
    items = spark.createDataFrame([(i, f"w{i % 50} w{i % 7} w{i % 3}") for i in range(300)], "item int, t string")
    asked = spark.createDataFrame([(i, f"w{i} w{i % 7}") for i in range(20)], "q int, x string")
    one, many = (sorted(map(tuple, retrieve.nearest_held(asked, items, ["q"], "x", "item", "t", 4, held=h).collect())) for h in (1000, 70))
    assert one == many and len(one) == 80
    concepts = spark.createDataFrame([(f"u{i}", f"name {i} of thing", f"words about {i}", [f"alias{i}", None]) for i in range(60)], "uri string, label string, description string, aliases array<string>")
    qs = spark.createDataFrame([(1, "name 7 thing"), (2, "alias33"), (3, "zzz"), (4, " "), (5, "nmae 12")], "query_id int, query string")
    every = []
    for q in qs.collect():
        if q["query"].strip():
            got = []
            for c in concepts.collect():
                names = max(ontology.weighted_ratio(q["query"], n) for n in [c.label, *c.aliases] if n)
                got.append((-round(max(names, 0.6 * ontology.partial_ratio(q["query"], c.description)) / 100, 9), c.label, c.uri))
            every += [(q.query_id, u, label, -s, i + 1) for i, (s, label, u) in enumerate(sorted(got)[:5])]
    for held in (1000, 17):
        assert sorted(map(tuple, ontology.search(qs, concepts, held=held).collect())) == sorted(every)


def test_label_words_and_caps(spark):
    r = spark.createDataFrame([("P17 : country",), ("P6 : head of government",), ("of_the flood",), ("a:b:c d",)], "r string").select(txt.label_tokens("r").alias("w"))
    assert [x.w for x in r.collect()] == [["country"], ["head", "government"], ["flood"], ["b", "c", "d"]]
    d = spark.createDataFrame([({"A": [["1", "2"], ["x"], None, ["3", "4"], ["5", "6"]], "B": [["7", "8"]]},), (None,)], "relations map<string,array<array<string>>>")
    assert [x.l for x in d.select(strategies.relation_lines("relations", 2, 3).alias("l")).collect()] == ["- 1 A 2\n- 3 A 4\n- 7 B 8", ""]


def test_means_of_one_large_community(spark):
    v = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "big").otherwise(F.concat(F.lit("c"), F.col("id") % 11)).alias("community"), F.array((F.col("id") % 5).cast("double"), F.lit(1.0)).alias("vector")).repartition(5)
    got = {r.community: r.vector for r in graph.unit_means(v).collect()}
    want = {r.community: (r.a, r.b) for r in v.groupBy("community").agg(F.avg(F.col("vector")[0]).alias("a"), F.avg(F.col("vector")[1]).alias("b")).collect()}
    assert set(got) == set(want) and all(abs(got[c][0] - a / (a * a + b * b) ** 0.5) < 1e-9 for c, (a, b) in want.items())
    assert graph.unit_means(v.limit(0)).count() == 0 and graph.unit_means(v.limit(1).select("community", F.array(F.lit(0.0)).alias("vector"))).count() == 0
