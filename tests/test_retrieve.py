"""Hashed vectors, rankings with ties, fusion, overlap, matches: against known values and plain loops."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.functions import embed, text as txt
from braidwork.operators import retrieve

CHUNKS = [(1, "The pump failed because the seal wore out."), (2, "Routine maintenance was performed in June."), (3, "A pressure spike triggered the alarm.")]


def test_known_rankings(spark):
    index = spark.createDataFrame(CHUNKS, "chunk int, text string").repartition(2)
    asked = spark.createDataFrame([(1, "pump seal failure"), (2, "alarm pressure spike"), (3, "why did the pump fail"), (4, "maintenance"), (5, "")], "q int, text string")
    got = {}
    for r in retrieve.nearest(asked, index, "q", "chunk", "text", 3).orderBy("q", "rank").collect():
        got.setdefault(r.q, []).append((r.chunk, round(r.score, 6)))
    assert got == {1: [(1, 0.365148), (2, 0.0), (3, 0.0)], 2: [(3, 0.408248), (1, 0.0), (2, 0.0)], 3: [(1, 0.424264), (3, 0.316228), (2, 0.0)], 4: [(2, 0.408248), (1, 0.0), (3, 0.0)], 5: [(1, 0.0), (2, 0.0), (3, 0.0)]}
    assert retrieve.nearest(asked.limit(0), index, "q", "chunk", "text").count() == 0
    assert retrieve.nearest(asked, index.limit(0), "q", "chunk", "text").count() == 0
    some = retrieve.nearest(asked, index, "q", "chunk", "text", 3, least=0.1)
    assert some.where("score < 0.1").count() == 0 and some.count() == 5


def test_passes_of_queries(spark, monkeypatch):
    index = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(30)] + [(99, None)], "i int, v array<double>").repartition(3)
    q = index.where("i < 7").withColumnRenamed("i", "q")
    one = sorted(map(tuple, retrieve.nearest(q, index, "q", "i", "v", 4, "cosine", None).collect()))
    monkeypatch.setattr(retrieve, "QUERIES", 2)
    assert sorted(map(tuple, retrieve.nearest(q, index, "q", "i", "v", 4, "cosine", None).collect())) == one and len(one) == 28
    best = [(r.q, r.i) for r in retrieve.nearest(q, index, "q", "i", "v", 1, "l2_inverse", None).collect()]
    assert sorted(best) == [(k, k % 5) for k in range(7)]


def test_bucket_matches_md5(spark):
    words = ["pump", "seal", "the", "é", "x" * 50]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for dim in (256, 300, 65536, 1000003):
        want = [int(hashlib.md5(w.encode()).hexdigest(), 16) % dim for w in words]
        assert [r.b for r in df.select(embed.bucket(F.col("w"), dim).alias("b")).collect()] == want
    assert [embed.Hasher()._bucket(w) for w in ("pump", "seal", "alarm", "maintenance", "the")] == [73, 63, 112, 189, 87]
    rows = embed.sparse(spark.createDataFrame(CHUNKS, "id int, text string"), "id", "text").collect()
    dense = embed.Hasher()([t for _, t in CHUNKS])
    assert all(abs(dense[r.id - 1, r.bucket] - r.weight) < 1e-12 for r in rows) and np.allclose((dense**2).sum(1), 1)
    e = embed.embed(spark.createDataFrame(CHUNKS, "id int, text string"), "text").first()
    assert np.allclose(e.vector, dense[0])


def test_fusion(spark):
    r = lambda xs: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(xs)], "query_id int, item string, rank int")
    got = [(x.item, x.score) for x in retrieve.fuse([r("AB"), r("BC")], ["item"]).orderBy("rank").collect()]
    assert [g[0] for g in got] == ["B", "A", "C"] and abs(got[0][1] - (1 / 62 + 1 / 61)) < 1e-11
    tied = [x.item for x in retrieve.fuse([r("A"), r("B")], ["item"]).orderBy("rank").collect()]
    assert tied == ["A", "B"]
    with pytest.raises(ValueError, match="at least one"):
        retrieve.fuse([], ["item"])


def test_overlap(spark):
    edges = spark.createDataFrame([(1, "pump_a", "CAUSES", "seal-leak", None), (2, "pump", "causes", "x", "d9"), (3, "z", None, "y", "d1")], "edge_id int, source string, type string, target string, document_id string")
    q = spark.createDataFrame([(1, "pump causes leak"), (2, "  "), (3, "related")], "query_id int, query string")
    got = retrieve.overlap(q, edges).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.edge_id, r.score) for r in got] == [(1, 1, 3.0), (1, 2, 2.0), (3, 3, 1.0)]
    assert got[0].evidence == "pump_a —CAUSES→ seal-leak" and got[0].document_id == "pump_a" and got[1].document_id == "d9"


def test_centroids_and_matches(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [-1.0, 0.0])], "g int, v array<double>")
    got = {r.g: r.centroid for r in retrieve.centroids(v, "g", "v").collect()}
    assert np.allclose(got[1], [0.5**0.5] * 2) and got[2] == [0.0, 0.0]
    events = spark.createDataFrame([("d", "e1", 0, "pump failure", "ACTION_OCC", "the pump failure came"), ("d", "e2", 1, "seal leak", None, "x")], "doc_id string, event_id string, pos int, event_text string, event_tag string, text string")
    spans = spark.createDataFrame([("d", "s1", "failure of pump"), ("d", "s2", "nothing here")], "doc_id string, span_id string, span_text string")
    assert {r.span_id: r.event_id for r in retrieve.soft_match(spans, events).collect()}["s1"] == "e1"
    assert [(r.span_id, r.event_id) for r in retrieve.best_by_jaccard(spans, events).collect()] == [("s1", "e1")]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(txt.claim_label(lit("It REFUTES the claim"))) == "REFUTES" and one(txt.claim_label(lit("nonsense"))) == "NOT_ENOUGH_INFO"
    assert one(txt.rationale(lit("LABEL: X\nRATIONALE: a\nb "))) == "a\nb"
    assert one(txt.words(lit("A b C  d"))) == ["a", "b", "c", "d"]
    assert one(txt.truncated(lit("abcdef"), 3)) == "abc\n... (truncated)" and one(txt.truncated(lit("abc"), 3)) == "abc"
    assert one(txt.canonical_relation(lit("P17 : country"))) == "P17" and one(txt.label_tokens(lit("part of the part"))) == ["part", "part"]
    assert one(txt.span_ids(lit("183_184_x"))) == [183, 184]
    assert one(txt.mention_key(lit("  The  Pump "))) == "the pump" and one(txt.mention_key(lit("  "))) is None
    assert one(txt.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b")))) == 0.5
    assert one(txt.slug(lit("a b/c"))) == "a_b_c" and one(txt.error_summary(lit("x\n err \n\n"))) == "err"
    assert one(embed.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))) == 0.0
