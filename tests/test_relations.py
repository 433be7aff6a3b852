"""Evaluation against plain sets, invariants, tie and slice rules."""

import random

from pyspark.sql import functions as F

from braidwork.operators import filters, relations, runtime

DOC = "document_id string, relations map<string,array<array<string>>>, pred_relations map<string,array<array<string>>>"


def rows():
    rng = random.Random(1)
    pair = lambda: [f"e{rng.randrange(4)}", f"e{rng.randrange(4)}"]
    make = lambda: {r: [pair() for _ in range(rng.randrange(4))] for r in ("A", "B")}
    return [(f"d{i}", make(), make()) for i in range(12)] + [("x", None, {"A": [["a", "b"], None, ["a"], ["a", None]]}), ("y", {}, None)]


def plain(m):
    return {(r, *p) for r, ps in (m or {}).items() for p in ps or [] if p and len(p) == 2 and None not in p}


def test_scores(spark):
    data = rows()
    docs = spark.createDataFrame(data, DOC)
    gold, pred = relations.triples(docs), relations.triples(docs, "pred_relations")
    m = relations.matched(gold, pred)
    tp = sum(len(plain(g) & plain(p)) for _, g, p in data)
    fp = sum(len(plain(p) - plain(g)) for _, g, p in data)
    fn = sum(len(plain(g) - plain(p)) for _, g, p in data)
    r = relations.micro(m).first()
    assert (r.tp, r.fp, r.fn) == (tp, fp, fn) and abs(r.f1 - 2 * tp / (2 * tp + fp + fn)) < 1e-12
    per = {x.rel: x.tp for x in relations.per_relation(m).collect()}
    both = {x.rel: x.tp for x in relations.rollup(m).collect()}
    assert both == per | {None: tp}
    echo = relations.micro(relations.matched(gold, gold)).first()
    assert (echo.precision, echo.recall, echo.f1) == (1.0, 1.0, 1.0)
    none = relations.micro(relations.matched(gold, gold.limit(0))).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    empty = relations.micro(relations.matched(gold.limit(0), gold.limit(0))).first()
    assert (empty.tp, empty.f1) == (0, 0.0)
    assert relations.macro(m).first().documents == len([1 for _, g, p in data if plain(g) | plain(p)])


def test_golden_counts(spark):
    r = relations.scores(spark.createDataFrame([(32, 1, 29)], "tp bigint, fp bigint, fn bigint")).first()
    assert (round(r.precision, 5), round(r.recall, 5), round(r.f1, 5)) == (0.9697, 0.52459, 0.68085)


def test_soft_credit_and_bags(spark):
    g = spark.createDataFrame([("d", "a", "b", "CAUSE"), ("d", "c", "e", "CAUSE")], "document_id string, head string, tail string, rel string")
    p = spark.createDataFrame([("d", "a", "b", "cause"), ("d", "b", "a", "CAUSE"), ("d", "a", "z", "CAUSE"), ("d", "q", "r", "CAUSE"), ("d", "c", "e", "RESULT")], g.schema)
    got = {(r.head, r.tail): (r.match_kind, r.credit) for r in relations.soft_credit(g, p).collect()}
    assert got == {("a", "b"): ("exact", 1.0), ("b", "a"): ("undirected", 0.75), ("a", "z"): ("one_end", 0.5), ("q", "r"): ("wrong", 0.0), ("c", "e"): ("undirected", 0.75)}
    s = relations.soft_scores(relations.soft_credit(g, p), g).first()
    assert (s.soft_precision, s.soft_recall) == (3.0 / 5, 1.5)
    twice = p.unionAll(p.where("head = 'a' AND tail = 'b'"))
    assert relations.bag_scores(g, twice, False).first().tp == 3
    assert relations.bag_scores(g, p, True).first().fn == 2
    assert relations.bag_scores(g, p, True, compatible=True).first().fn == 0


def test_maps_and_merge(spark):
    docs = spark.createDataFrame([("d", {"A": [["x", "y"], ["u", "v"], ["x", "y"]]}, {"A": [["u", "v"], ["n", "m"]], "B": [["q", "r"]]})], DOC)
    long = relations.triples(docs)
    assert relations.as_maps(long).first().relations == {"A": [["x", "y"], ["u", "v"], ["x", "y"]]}
    out = relations.merged(long, relations.triples(docs, "pred_relations"))
    assert relations.as_maps(out).first().relations == {"A": [["x", "y"], ["u", "v"], ["n", "m"]], "B": [["q", "r"]]}


def test_missing_gold(spark):
    m = "map<string,array<array<string>>>"
    pred = spark.createDataFrame([("a", {}, None), ("b", None, None), ("c", None, None)], f"document_id string, relations {m}, pred_relations {m}")
    gold = spark.createDataFrame([("a", {"R": [["x", "y"]]}), ("b", {"R": [["x", "y"]]})], f"document_id string, relations {m}")
    e = relations.evaluated_documents(pred, gold)
    assert tuple(relations.coverage(e).first()) == (3, 2, 1)
    assert {r.document_id: r.relations for r in e.collect()} == {"a": {}, "b": {"R": [["x", "y"]]}, "c": None}


def test_slices(spark):
    df = spark.createDataFrame([(i, "train" if i % 2 else "test", {"R": [["a", "b"]]} if i % 3 else {"R": []}) for i in range(20)], "i int, type string, relations map<string,array<array<string>>>").repartition(3)
    ids = lambda x: [r.i for r in x.orderBy("i").collect()]
    assert ids(filters.skip_limit(filters.of_type(df, "train"), [F.col("i")], 2, 3)) == [5, 7, 9]
    assert ids(filters.of_type(df, "all")) == list(range(20)) and ids(filters.skip_limit(df, [F.col("i")], 18)) == [18, 19]
    assert ids(filters.few_shots(df, 2, [F.col("i")], pool=3)) == [1, 5]
    assert ids(filters.few_shots(df, 3, [F.col("i")], skip=1, pool=2, pool_first=False)) == [5, 7]
    assert filters.primitive_columns(df).columns == ["i", "type"]
    assert ids(filters.named(df, type=" TRAIN ,x")) == list(range(1, 20, 2)) and ids(filters.named(df, type="")) == list(range(20))
    assert filters.without_labels(spark.createDataFrame([("a",), (None,), ("b",)], "rel string"), ["a"]).count() == 2


def test_energy(spark):
    runs = spark.createDataFrame([("OK", 12.0, 100), ("FAILED", 1.0, 100)], "status string, elapsed_seconds_doc double, n_eligible_documents bigint")
    a, b = runtime.energy(runs).collect()
    assert (round(a.energy_kwh_doc, 9), round(a.co2_kg_doc, 9), a.estimated_total_minutes, round(a.estimated_total_co2_g, 9)) == (0.001, 0.000045, 20.0, 4.5)
    assert b.energy_kwh_doc is None and b.estimated_total_co2_g is None
    assert runtime.build_hash(a=1, b=2) == runtime.build_hash(b=2, a=1) != runtime.build_hash(a=2) and len(runtime.build_hash()) == 12
    old = spark.createDataFrame([("m", "d", 1), ("m", "e", 1)], "method string, dataset string, v int")
    assert sorted(map(tuple, relations.overridden(old, old.where("dataset = 'd'").withColumn("v", F.lit(2)), ["method", "dataset"]).collect())) == [("m", "d", 2), ("m", "e", 1)]
